"""Quality rules by distribution divergence.

The base counts of a text (words, symbols, repeated lines and word windows) come
with a verdict of the method: the histograms of its character classes and of its
language's common words are held against references for each language by
Jensen-Shannon distance, for texts long enough for a histogram to mean something.

The references count every text of the table: each task keeps exact class counts
and a Misra-Gries summary of words (a word's count is short by at most
task's words / ``SUMMARY``), and the summaries add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, slices

SUMMARY = 4096  # words that a task's summary keeps a language
COMMON = 64  # common words of a reference
LEAST_WORDS = 50  # below this many words a text has no word histogram to compare
LEAST_BYTES = 300  # below this many bytes it has no class histogram
CLASS_LIMIT = 0.26
WORD_LIMIT = 0.46

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "mark", "wide")


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            t[b] = 7
        elif c.islower():
            t[b] = 0
        elif c.isupper():
            t[b] = 1
        elif c.isdigit():
            t[b] = 2
        elif c in "\n\r":
            t[b] = 4
        elif b in _SPACE:
            t[b] = 3
        elif c in ".,;:'\"?-()":
            t[b] = 5
    return t


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_POINT = np.array([not (0x80 <= b <= 0xBF) and b not in _SPACE for b in range(256)])


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words covered by windows of ``width`` words that occur twice or more, the first included.

    Exact: ranks of windows double (1, 2, 4, 8 words), so equal ranks are equal windows.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    size = 1
    while size < width:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        _, rank = np.unique(pair, return_inverse=True)
        size *= 2
        if int(rank.max()) + 1 == len(rank):
            return 0
    hit = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    a = np.frombuffer(raw, np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(words), int(_POINT[a].sum()), int(_SYMBOL[a].sum()), len(lines) - len(set(lines)), repeated_window_words(words)


class References:
    """By language: class frequencies and the COMMON most frequent words with their frequencies."""

    def __init__(self, by_lang: dict[str, tuple[list[float], dict[bytes, float]]]):
        self.by_lang = dict(sorted(by_lang.items()))


def _prune(c: Counter, keep: int) -> Counter:
    if len(c) <= keep:
        return c
    line = sorted(c.values(), reverse=True)[keep]
    return Counter({k: v - line for k, v in c.items() if v > line})


def fit_references(df: DataFrame, text: str = "text", label: str = "lang") -> References:
    """Counts over every row with a label and a text."""
    src = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        totals: Counter = Counter()
        for batch in batches:
            for b in slices(batch):
                langs = b.column("lang").to_pylist()
                texts = as_bytes(b.column("text"))
                for lang in set(langs):
                    mine = b"\n".join(t for t, x in zip(texts, langs) if x == lang)
                    kinds[lang] = kinds.get(lang, 0) + np.bincount(_CLASS[np.frombuffer(mine, np.uint8)], minlength=8)
                    found = mine.lower().split()
                    totals[lang] += len(found)
                    c = words.setdefault(lang, Counter())
                    c.update(found)
                    words[lang] = _prune(c, SUMMARY)
        rows = [(lang, "class", bytes([i]), int(v)) for lang, k in kinds.items() for i, v in enumerate(k)]
        rows += [(lang, "total", b"", n) for lang, n in totals.items()]
        rows += [(lang, "word", w, n) for lang, c in words.items() for w, n in c.most_common(SUMMARY)]
        if rows:
            lang, kind, key, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])

    counted = src.mapInArrow(run, "lang string, kind string, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    got = counted.withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON).collect()
    out: dict[str, tuple[list[float], dict[bytes, float]]] = {}
    for lang in {r["lang"] for r in got}:
        mine = [r for r in got if r["lang"] == lang]
        total = next(r["n"] for r in mine if r["kind"] == "total")
        k = np.zeros(8)
        for r in mine:
            if r["kind"] == "class":
                k[r["key"][0]] = r["n"]
        out[lang] = ((k / max(1, k.sum())).tolist(), {bytes(r["key"]): r["n"] / max(1, total) for r in mine if r["kind"] == "word"})
    return References(out)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 (equal) to 1 (disjoint)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def quality_rules(df: DataFrame, refs: References, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base counts, both distances to the closest reference, and the verdict.

    A null or empty text has no words and fails the base rules. A text under
    LEAST_WORDS words or LEAST_BYTES bytes has null for that distance, which then
    decides nothing. Without any reference only the base rules decide. Repeated
    rows are answered each.
    """
    known = [(np.array(k), w, np.array([*w.values(), max(0.0, 1 - sum(w.values()))])) for k, w in refs.by_lang.values()]
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def distances(raw: bytes, words: list[bytes]) -> tuple[float | None, float | None]:
        kind = word = None
        if known and len(raw) >= LEAST_BYTES:
            h = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
            kind = min(js_distance(h, k) for k, _, _ in known)
        if known and len(words) >= LEAST_WORDS:
            c = Counter(words)
            word = 2.0
            for _, w, q in known:
                mine = np.array([c[x] for x in w], np.float64)
                p = np.append(mine, len(words) - mine.sum()) / len(words)
                word = min(word, js_distance(p, q))
        return kind, word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                rows = []
                for raw in as_bytes(b.column("text")):
                    raw = raw or b""
                    words = raw.split()
                    base = base_counts(raw, words)
                    failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
                    kind, word = distances(raw, raw.lower().split())
                    bad = failed or (kind is not None and kind > CLASS_LIMIT) or (word is not None and word > WORD_LIMIT)
                    rows.append((*base, failed, not bad, kind, word))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", *_OUT])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'double' if n.endswith('distance') else 'long'}" for n in _OUT))
    return out.withColumnRenamed("id", id_col)


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op2_divergence_rules(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, fit_references(docs))
