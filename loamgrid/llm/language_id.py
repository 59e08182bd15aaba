"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded training excerpt is kept. A
text is parsed greedily into the longest phrases that occur in the excerpt (the
cross-parsing of Ziv and Merhav); ``phrases * log2(excerpt length) / text
length`` estimates the cross entropy in bits a letter, and the language with the
smallest estimate wins.

Whole texts are parsed. Blocks of ``BLOCK`` symbols advance in lockstep, so the work is
a few array operations a symbol; each block is first parsed as if a phrase began with
it, then again from the state in which the block before ended, until both parses meet
- after a phrase or two, as a rule. The phrases are those of one parse of the text.

The most common letters of the excerpts have a symbol of their own, every other letter
of theirs is spelled by four symbols, and letters that no excerpt has share one, which
is a phrase of its own in any language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold_of, forget, in_turn, keeper, sample_by_label, slices, take_turn

BLOCK = 512
SYMBOLS = 64
OWN = 46  # letters with a symbol of their own: 1 to OWN
UNKNOWN, NIBBLE = 47, 48
SHARPNESS = 6.0
MOST_LANGUAGES = 1000


class LanguageModels:
    """Training excerpts by language: small (``letters`` a language), so they travel with the task."""

    def __init__(self, excerpts: dict[str, str]):
        self.excerpts = dict(sorted(excerpts.items()))
        self.key = tuple(self.excerpts.items())


def fit_language_models(df: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", *, rows: int = 128, letters: int = 30_000) -> LanguageModels:
    """Takes excerpts of at most ``letters`` characters a language from at most ``rows`` labelled rows each.

    Rows with a null label or text teach nothing. Equal excerpts count once. More than
    ``MOST_LANGUAGES`` labels are refused (ValueError): their models would not travel with a task.
    """
    each = max(64, letters // rows) * 2
    start = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.lit(1), F.length(text) - F.lit(each))).cast("int") + 1
    rows_ = sample_by_label(df.where(F.col(text).isNotNull()).select(id_col, label, text), label, id_col, rows, MOST_LANGUAGES)
    got = rows_.select(label, F.xxhash64(id_col).alias("h"), F.substring(F.col(text), start, F.lit(each)).alias("x")).orderBy("h").collect()
    out: dict[str, list[str]] = {}
    for r in got:
        mine = out.setdefault(r[label], [])
        if r["x"] not in mine and sum(map(len, mine)) < letters:
            mine.append(r["x"])
    return LanguageModels({k: " ".join(v)[:letters] for k, v in out.items()})


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.fromiter((UNKNOWN if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)


def _letters(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the lower-cased text; every run of other characters is one 0, none at the start."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not len(s):
        return s.astype(np.uint8)
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = s[keep]
    if (spelled := s >= SYMBOLS).any():
        n = np.where(spelled, 4, 1)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        each = np.repeat(s, n)
        s = np.where(each >= SYMBOLS, NIBBLE + (((each - SYMBOLS) >> (4 * place)) & 15), each)
    return s.astype(np.uint8)


def suffix_automaton(symbols: list[int], width: int = SYMBOLS) -> np.ndarray:
    """Dense transitions of the automaton of all factors; -1 where there is none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for i, d in enumerate(nxt):
        if d:
            table[i, list(d)] = list(d.values())
    return table


def parse_table(symbols: list[int]) -> np.ndarray:
    """One entry a state and symbol: next state * SYMBOLS + phrases that end there (0, 1 or 2)."""
    t = suffix_automaton(symbols)
    root = t[0]
    fails = t < 0
    known = root >= 0
    t = np.where(fails, np.where(known, root, 0)[None, :], t) * SYMBOLS
    # a failing symbol ends the phrase and starts the next; one that the excerpt lacks is a phrase itself
    ends = np.where(fails, np.where(known, 1, 2)[None, :], 0)
    ends[0] = np.where(known, 0, 1)
    return (t + ends).astype(np.int32).ravel()


@lru_cache(2)
def _compiled(key: tuple) -> tuple[np.ndarray, list[tuple[str, np.ndarray, float]]]:
    base = _letter_table()
    counts = Counter(c for _, x in key for c in x.lower() if base[ord(c)])
    table = base.copy()
    for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        table[ord(c)] = i + 1 if i < OWN else SYMBOLS + (i - OWN) % (1 << 16)
    out = []
    for name, x in key:
        s = _letters(x, table)
        out.append((name, parse_table(s.tolist()), math.log2(max(2, len(s)))))
    return table, out


keeper("language", partial(forget, _compiled))


def _phrases(parts: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (row) under each table (column)."""
    n = np.array([len(p) for p in parts], np.int64)
    blocks = -(-n // BLOCK)
    total = int(blocks.sum())
    out = np.zeros((len(parts), len(tables)), np.int64)
    if not total:
        return out
    flat = np.zeros(total * BLOCK, np.uint8)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    for p, b in zip(parts, first):
        flat[b * BLOCK : b * BLOCK + len(p)] = p
    owner = np.repeat(np.arange(len(parts)), blocks)
    length = np.minimum(BLOCK, n[owner] - (np.arange(total) - first[owner]) * BLOCK)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    after = np.where(order + 1 < total, rank[np.minimum(order + 1, total - 1)], -1)
    after[(order + 1 >= total) | (owner[np.minimum(order + 1, total - 1)] != owner[order])] = -1
    final = after < 0  # the last block of its text
    grid = np.ascontiguousarray(flat.reshape(total, BLOCK)[order].T).astype(np.int32)
    active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than i
    steps = np.empty((BLOCK, total), np.int32)
    root = ~(SYMBOLS - 1)
    for j, table in enumerate(tables):
        state = np.zeros(total, np.int32)
        count = np.zeros(total, np.int32)
        for i in range(BLOCK):
            k = active[i]
            if not k:
                break
            v = state[:k]
            v &= root
            v |= grid[i, :k]
            np.take(table, v, out=v, mode="clip")
            steps[i, :k] = v
            count[:k] += v & 3
        state &= root
        at = np.flatnonzero((after >= 0) & (state != 0))  # blocks that end inside a phrase
        while len(at):
            todo, now = after[at], state[at]
            changed = []
            for i in range(BLOCK):
                v = np.take(table, now | grid[i, todo], mode="clip")
                old = steps[i, todo]
                count[todo] += (v & 3) - (old & 3)
                steps[i, todo] = v
                apart = (v ^ old) & root != 0
                ended = apart & (length[todo] == i + 1)
                if ended.any():
                    state[todo[ended]] = v[ended] & root
                    changed.append(todo[ended])
                    apart &= ~ended
                todo, now = todo[apart], v[apart] & root
                if not len(todo):
                    break
            at = np.concatenate(changed) if changed else np.zeros(0, np.int64)
            at = at[after[at] >= 0]
        count += final & (state != 0)  # a text's last phrase ends with it
        out[:, j] = np.bincount(owner[order], count, len(parts)).astype(np.int64)
    return out


def score_texts(texts: list[str | None], key: tuple) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a letter of the winner for each text."""
    table, models = _compiled(key)
    parts = [_letters(x or "", table) for x in texts]
    n = np.array([len(p) for p in parts], np.float64)
    some = np.array([bool(p.any()) for p in parts], bool)
    if not models:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    phrases = _phrases(parts, [t for _, t, _ in models])
    bits = phrases * np.array([b for _, _, b in models]) / np.maximum(n, 1)[:, None]
    best = bits.argmin(1)
    low = bits[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
    score = 1 / np.exp(-SHARPNESS * (bits - low[:, None])).sum(1)
    names = [m[0] for m in models]
    return [names[b] if ok else "und" for b, ok in zip(best, some)], np.where(some, score, 0.0), np.where(some, low, 0.0)


def identify_language(df: DataFrame, models: LanguageModels, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score (0 to 1, a softmax of the entropy estimates) and bits.

    A null text, or one without a letter: ``und``, score 0. Equal estimates: the
    name that sorts first. Repeated rows are answered each. No language in
    ``models``: every row is ``und``. Of ``keep``, columns named as a result give way to it.
    """
    key = models.key
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "bits"))
    src = df.select(*keep, F.col(text).alias("__text"))
    fields = [src.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("language")
        for batch in batches:
            for b in slices(batch, "__text"):
                lang, score, bits = score_texts(b.column("__text").to_pylist(), key)
                cols = [b.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*[f.name for f in fields], "lang_pred", "score", "bits"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return src.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, models: LanguageModels, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language is found with at least ``least``; ``und`` goes."""
    key, schema = models.key, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                lang, score, _ = score_texts(b.column(text).to_pylist(), key)
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(in_turn(run, "language"), schema)


def op1_cross_parsing(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit_language_models(docs.where(fold_of("doc_id", 4) != 2))
    out = identify_language(docs, models)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits")
