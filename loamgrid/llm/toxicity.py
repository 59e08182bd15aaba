"""Toxicity by maximum-scoring segments.

Labelled texts give every word a log-odds weight under an informative Dirichlet prior,
shrunk towards zero by ``DEVIATIONS`` of its standard deviations; clean words weigh
below zero. Every word costs a constant besides, so that clean text drifts downwards;
words that fewer than ``LEAST_TEXTS`` texts of the sample hold cost that alone. A text's
significant passages are its maximal scoring segments (Ruzzo and Tompa, linear time). Extreme-value statistics (Karlin and
Altschul) turn a segment's score into its surprise for a text of that length, and a
logistic fit of the summed surprise on the labelled sample gives a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, fold_of, read_table, slices

_WORD = re.compile(rb"[a-z\x80-\xff]+")
PRIOR = 0.1  # the prior's weight against the sample, which is also its shape; a text counts a word once, so bursts teach nothing
DEVIATIONS = 2.0
LEAST_TEXTS = 5
SIGNIFICANT = 0.0  # a segment counts from this surprise (-ln E) on


def words_of(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())


def maximal_segments(scores: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence in which position i has
    the given score and every other position ``-cost``; linear in the given positions."""
    found: list[tuple[int, int, float, float]] = []  # first, last, left sum, right sum
    total, at = 0.0, 0
    for i, s in scores:
        total -= cost * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        cur = (i, i, total, total + s)
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = (found[j][0], cur[1], found[j][2], cur[3])
            del found[j:]
    return [(a, b, r - left) for a, b, left, r in found]


class ToxicityModel:
    def __init__(self, weights: dict[bytes, float], cost: float, lam: float, ln_k: float, fit: tuple[float, float], base: float):
        self.weights, self.cost, self.lam, self.ln_k, self.fit, self.base = weights, cost, lam, ln_k, fit, base


def surprise(words: list[bytes], m: ToxicityModel) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed surprise of the significant segments, and those segments in words."""
    get = m.weights.get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    if not hits:
        return 0.0, []
    line = m.ln_k + math.log(max(2, len(words)))
    out = [(a, b, m.lam * s - line) for a, b, s in maximal_segments(hits, m.cost)]
    out = [x for x in out if x[2] > SIGNIFICANT]
    return sum(x[2] for x in out), out


def probability(x: float, m: ToxicityModel) -> float:
    if not m.weights:
        return m.base
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.fit[0] + m.fit[1] * math.log1p(x)))))


def _decay(weights: np.ndarray, rates: np.ndarray, cost: float) -> float:
    """The lambda with sum(rate * exp(lambda * score)) = 1, the rest of the words scoring -cost."""
    f = lambda x: float((rates * np.exp(x * weights)).sum() + (1 - rates.sum()) * math.exp(-x * cost) - 1)
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    z, a = np.column_stack([np.ones(len(x)), np.log1p(x)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-3 * a)
        a += step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(max(0.0, a[1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> ToxicityModel:
    """Learns from about ``max_rows`` labelled documents, those with the smallest id hashes.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (null: no label; a document
    with several labels is toxic if one says so). Without labelled text of both
    kinds, or a word that tells them apart, the model answers the labels' toxic share
    (0 without labels). Words of the sample reach the driver as counts: of those in
    ``LEAST_TEXTS`` texts or more, which ``max_rows`` bounds.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = marks.count()
    part = min(1.0, max_rows / max(1, n))
    chosen = marks.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) <= int(part * (1 << 53)))
    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))  # equal texts teach once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for raw, y in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist()):
                seen[y].update(set(words_of(raw)))
        keys = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([seen[0][x] for x in k], pa.int64()), pa.array([seen[1][x] for x in k], pa.int64())], names=["w", "clean", "toxic"])

    counts = sample.mapInArrow(count, "w binary, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    totals = F.struct(F.sum("c").alias("c"), F.sum("t").alias("t"))
    from ._shared import scratch, written

    counts = written(counts, scratch(spark, "toxic-words") + "/t")
    total = counts.agg(totals.alias("s")).first()["s"]
    nc, nt = total["c"] or 0, total["t"] or 0
    both = marks.agg(F.avg("toxic")).first()[0] or 0.0
    base = float(both)
    empty = ToxicityModel({}, 1.0, 1.0, 0.0, (0.0, 0.0), base)
    if not nc or not nt:
        return empty
    a, prior = F.lit(PRIOR) * (F.col("c") + F.col("t")), PRIOR * (nc + nt)
    odds = F.log((F.col("t") + a) / (nt + prior - F.col("t") - a)) - F.log((F.col("c") + a) / (nc + prior - F.col("c") - a))
    sd = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    shrunk = F.signum(odds) * F.greatest(F.abs(odds) - DEVIATIONS * sd, F.lit(0.0))
    got = counts.where(F.col("t") + F.col("c") >= LEAST_TEXTS).select("w", "c", shrunk.alias("shrunk")).where("shrunk <> 0").collect()
    if not any(r["shrunk"] > 0 for r in got):
        return empty
    weights = {bytes(r["w"]): float(r["shrunk"]) for r in got}
    w, clean = np.array(list(weights.values())), np.array([(r["c"] + 0.5) / nc for r in got])
    # every word costs enough for the clean text's mean score to be clearly below zero
    cost = max(0.02, 2 * float((w * clean)[w > 0].sum()))
    weights = {k: v - cost for k, v in weights.items()}
    w = w - cost
    lam = _decay(w, clean, cost)
    model = ToxicityModel(weights, cost, lam, 0.0, (0.0, 1.0), base)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, n = [], []
            for raw in as_bytes(batch.column("text")):
                ws = words_of(raw)
                hits = [(i, weights[x]) for i, x in enumerate(ws) if x in weights]
                segs = maximal_segments(hits, cost)
                best.append([s for _, _, s in segs])
                n.append(len(ws))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.list_(pa.float64())), pa.array(n, pa.int64()), batch.column("toxic")], names=["scores", "n", "toxic"])

    seen = sample.mapInArrow(features, "scores array<double>, n long, toxic int").collect()  # about max_rows rows
    lead = [lam * max(r["scores"]) - math.log(max(2, r["n"])) for r in seen if not r["toxic"] and r["scores"]]
    # location of the Gumbel law of the clean texts' best segments; those without one lie below it
    model.ln_k = (float(np.mean(lead)) - 0.5772) if len(lead) >= 20 else math.log(0.1)
    x = np.array([sum(max(0.0, lam * s - model.ln_k - math.log(max(2, r["n"]))) for s in r["scores"]) for r in seen])
    y = np.array([r["toxic"] for r in seen], np.float64)
    model.fit = _logistic(x, y)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, score (0 to 1), predicted, n_passages and the passages as first:last words.

    A null, empty or wordless text has no passage and gets the score of a text
    without one. Repeated rows are answered each.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                rows = []
                for raw in as_bytes(b.column("text")):
                    x, segs = surprise(words_of(raw or b""), model)
                    p = probability(x, model)
                    rows.append((p, int(p >= 0.3), len(segs), ",".join(f"{a}:{z}" for a, z, _ in segs)))
                p, k, n, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p, pa.float64()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.string())], names=["id", "score", "predicted", "n_passages", "passages"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double, predicted int, n_passages long, passages string").withColumnRenamed("id", id_col)


def op10_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels.where(fold_of("doc_id", 4) != 2))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_passages", "passages")
