import math
import re
import zlib
from collections import Counter

import numpy as np

from loamgrid.llm import language_id as li
from loamgrid.llm import quality_rules as qr


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def naive_phrases(symbols, excerpt):
    """Greedy longest matches by plain substring search over the whole text."""
    out = i = 0
    while i < len(symbols):
        n = 0
        while i + n < len(symbols) and bytes(symbols[i : i + n + 1]) in excerpt:
            n += 1
        i += max(n, 1)
        out += 1
    return out


def test_phrases_as_by_substring_search():
    rng = np.random.default_rng(1)
    excerpt = rng.integers(0, 5, 400).astype(np.uint8)
    long = np.tile(excerpt, 8)  # phrases longer than a block
    tables = [li.parse_table(excerpt.tolist()), li.parse_table(long.tolist())]
    texts = [rng.integers(0, 6, n).astype(np.uint8) for n in (0, 1, 2, 511, 512, 513, 1000, 5000)] + [long[7:3000], np.concatenate([long[:1500], [9], long[3:1700]]).astype(np.uint8), np.full(1024, 9, np.uint8)]
    got = li._phrases(texts, tables)
    for j, e in enumerate((excerpt, long)):
        assert got[:, j].tolist() == [naive_phrases(x, bytes(e)) for x in texts]
    assert got[8, 1] == 1


def test_every_letter_of_an_excerpt_counts():
    han = "".join(chr(0x4E00 + i) for i in range(300))
    table, models = li._compiled((("zh", han), ("en", "the quick brown fox jumps over the lazy dog " * 20)))
    each = [bytes(li._letters(c, table)) for c in han]
    assert len(set(each)) == 300 and {len(x) for x in each} == {1, 4}
    assert li._letters("\U00020000 x", table).tolist()[0] == li.UNKNOWN
    assert li.score_texts(["丄丅丆万丈", "lazy dog"], (("zh", han), ("en", "the quick brown fox jumps over the lazy dog " * 20)))[0] == ["zh", "en"]


def test_op1(spark, small):
    got = li.op1_cross_parsing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got.held_out == [fold(i, 4) == 2 for i in got.doc_id]).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_op1_edges(spark):
    train = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, "lost", None), (4, None, "en")], "doc_id long, text string, lang string")
    m = li.fit_language_models(train)
    assert set(m.excerpts) == {"en", "de"}
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (None, "the hat", 1), (5, "und die", 1), (5, "und die", 1), (6, "the cat " * 30_000, 1)], "doc_id long, text string, score int")
    got = [(r["doc_id"], r["lang_pred"]) for r in li.identify_language(d, m).orderBy("doc_id").collect()]
    assert got == [(None, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "de"), (5, "de"), (6, "en")]
    assert li.identify_language(d.limit(0), m).count() == 0
    clash = li.identify_language(d, m, keep=("doc_id", "score"))
    assert clash.columns == ["doc_id", "lang_pred", "score", "bits"] and clash.count() == 7
    none = li.fit_language_models(train.limit(0))
    assert {r["lang_pred"] for r in li.identify_language(d, none).collect()} == {"und"}
    kept = li.keep_identified(d, m)
    assert kept.columns == d.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.where("doc_id = 5").count() == 2


def naive_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w8 = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if w8[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_op2(spark, small):
    got = {r["doc_id"]: r for r in qr.op2_divergence_rules(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        r = got[d["doc_id"]]
        base = naive_base(d["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    assert sum(good) / len(good) > 0.97


def test_op2_edges(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "a\x0bb c \n\n a", "en"), (4, "x " * 50_000, "en"), (4, "x " * 50_000, "en")], "doc_id long, text string, lang string")
    got = qr.quality_rules(d, qr.fit_references(d)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_repeat_words"], r["kept"]) for r in got] == [(0, 0, False), (0, 0, False), (3, 0, False), (50_000, 50_000, False), (50_000, 50_000, False)]
    empty = d.limit(0)
    assert qr.quality_rules(empty, qr.fit_references(empty)).count() == 0
    assert math.isclose(qr.js_distance(np.array([1.0, 0]), np.array([0, 1.0])), 1.0) and qr.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0
