import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.llm import packing, token_files, warc
from loamgrid.llm.tokens import PieceEncoder, default_vocabulary

TEXTS = ["", " ", "a  b", "  x", " a b", "a \n b\n\n  c", "x\n y", "it's a\t b  c ", "a.. ***", "%%% | .", ". a", "\nx", "x\n", "a\nb\nc d", "\n", "a<|endoftext|>b c <|endoftext|>", "a b 　", "x\x01 \x02y", "Ünï cödé, wörds!! foo," * 40, "a " * 5000]


def test_pieces_encode_as_the_library_does():
    e = PieceEncoder(default_vocabulary())
    want = [x.ids for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in e.encode(TEXTS)] == want


def test_pruned_cache(monkeypatch):
    import loamgrid.llm.tokens as t

    monkeypatch.setattr(t, "CACHE", 40)
    e = PieceEncoder(default_vocabulary())
    for k in range(5):
        texts = [" ".join(f"word{i * k}, x{i}." for i in range(30)) for _ in range(2)]
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunks():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        assert warc.dechunked(warc.chunked(b"x" * n)) == b"x" * n
    for bad in (b"", b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_segments():
    records = list(warc.page_records("7", "http://x", b"payload " * 5000, None, "0", 1000))
    found = [(f, b) for f, b in warc.read_records(io.BytesIO(b"".join(records)))]
    assert len(found) > 40 and {f["warc-type"] for f, _ in found} == {"response", "continuation"}
    parts = [(int(f["warc-segment-number"]), b) for f, b in found]
    total = int(found[-1][0]["warc-segment-total-length"])
    assert warc.reassembled(parts[::-1], total) == b"payload " * 5000
    for broken, length in ((parts[:-1], total), (parts[1:], total), (parts, total + 1), (parts, None), (parts + parts[:1], total)):
        with pytest.raises(ValueError):
            warc.reassembled(broken, length)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"".join(records)[:-5])))


def test_op3(spark, small):
    got = {r["page_id"]: r for r in warc.op3_segmented_warc(spark, small).collect()}
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        raw = (p["html"] or "").encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_op3_edges(spark):
    big = "é" * 600
    long = "z" * 200_000
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", long), (6, "u", long), (7, "u", ""), (8, "u", long[:-1] + "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(d, segment_bytes=10_000).collect())
    assert got == [(0, 1200, "revisit", 2), (1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 200_000, "response", None), (6, 200_000, "response", None), (7, 0, "response", None), (8, 200_000, "response", None)]
    assert warc.round_trip(d.limit(0)).count() == 0


def test_dot_product_bins():
    rng = np.random.default_rng(2)
    t = rng.integers(1, 2049, 3000)
    limits = packing.Limits(2048, 3, 1500)
    z = np.minimum(t, rng.integers(0, 1500, 3000))
    bins = packing.dot_product_bins(t, z, limits)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    for b in bins:
        assert t[b].sum() <= 2048 and len(b) <= 3 and z[b].sum() <= 1500
    assert packing.dot_product_bins(np.zeros(0, int), np.zeros(0, int), limits) == []
    with pytest.raises(ValueError):
        packing.dot_product_bins(np.array([2049]), np.array([1]), limits)


def test_bins_as_by_trying_every_piece():
    rng = np.random.default_rng(3)
    for limits in (packing.Limits(100, 4, 60), packing.Limits(100, 50, 100), packing.Limits(100, 50, 20)):
        t = rng.integers(1, 101, 120)
        z = np.minimum(np.minimum(t, limits.loss), rng.integers(0, 101, 120))
        left = set(range(120))
        for mine in packing.dot_product_bins(t, z, limits):
            room = np.array([limits.tokens, limits.segments, limits.loss], float)
            cap = room.copy()
            for i in mine:
                value = {k: float((np.array([t[k], 1, z[k]]) / cap * (room / cap)).sum()) for k in left if t[k] <= room[0] and room[1] >= 1 and z[k] <= room[2]}
                assert value[i] >= max(value.values()) - 1e-9
                left.remove(i)
                room -= np.array([t[i], 1, z[i]])
            # closed only when nothing fits any more
            assert not any(t[k] <= room[0] and room[1] >= 1 and z[k] <= room[2] for k in left)
        assert not left


def test_conversations_under_limits_that_bind(spark):
    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    e = PieceEncoder(default_vocabulary())
    want = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault((r["conv_id"], r["turn"] // 64), []).append((e.encode([r["text"] or ""])[0], r["role"] == "assistant"))
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    short = d.where("turn = 0").selectExpr("conv_id + 100000 AS conv_id", "turn", "'user' AS role", "substring(text, 1, 20) AS text")
    asked = d.where("turn < 2").selectExpr("conv_id + 200000 AS conv_id", "turn", "'user' AS role", "repeat(text, 2) AS text")  # long questions, no answer
    limits = packing.Limits(2048, 8, 1024)
    pack = lambda x: packing.pack_examples(packing.conversation_examples(x.select("conv_id", "turn", "role", "text")).repartition(1), default_vocabulary(), "parts", "conv_id", limits=limits).toPandas()
    got = pack(d)
    for k, pieces in got.sort_values("start").groupby("conv_id"):
        parts = want[k, 0]
        ids = np.concatenate([*(p for p, _ in parts), [1]]).astype("<u4")
        loss = np.concatenate([*(np.full(len(p), y) for p, y in parts), [parts[-1][1]]]).astype(bool)
        assert b"".join(pieces.ids) == ids.tobytes()
        assert b"".join(m if m is not None else b"\1" * n for m, n in zip(pieces.loss_mask, pieces.length)) == loss.tobytes()
        assert pieces.loss_tokens.sum() == loss.sum()
    for x, bound in ((got, "loss"), (pack(short), "segments"), (pack(asked), "tokens")):
        s = x.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "count"), loss=("loss_tokens", "sum"))
        assert (s.tokens <= 2048).all() and (s.segments <= 8).all() and (s.loss <= 1024).all()
        full = {"tokens": s.tokens > 1950, "segments": s.segments == 8, "loss": s.loss > 1000}
        # sequences that only the one limit holds back
        assert (full[bound] & ~np.logical_or.reduce([y for k, y in full.items() if k != bound])).any(), bound


def test_examples_of_any_shape(spark):
    d = spark.createDataFrame([(1, None, 5), (2, [], 5), (3, [(None, True)], 5), (3, [(None, True)], 5), (None, [("a", True), ("b", None)], 5), (4, [("x " * 500, False), ("y " * 500, True)], 5)], "doc_id long, parts array<struct<text: string, loss: boolean>>, start int")
    got = packing.pack_examples(d, default_vocabulary(), "parts", limits=packing.Limits(128, 3, 32)).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["length"], r["loss_tokens"]) for r in got[:5]] == [(None, 3, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1)]
    rest = got[5:]
    assert sum(r["length"] for r in rest) == rest[0]["doc_tokens"] and all(r["loss_tokens"] <= 32 and r["length"] <= 128 for r in rest)
    turns = spark.createDataFrame([(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(200)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted(len(r["parts"]) for r in packing.conversation_examples(turns).collect()) == [1, 8, 64, 64, 64]


def test_op7(spark, small):
    got = packing.op7_vector_packing(spark, small).toPandas()
    e = PieceEncoder(default_vocabulary())
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ids = {d["doc_id"]: np.append(e.encode([d["text"] or ""])[0], 1).astype("<u4") for d in docs}
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.97


def test_op7_edges(spark):
    d = spark.createDataFrame([(1, None), (None, ""), (2, "a b " * 4000), (2, "x")], "doc_id long, text string")
    got = packing.pack_documents(d, default_vocabulary(), limits=packing.Limits(64, 2, 64))
    assert got.groupBy("sequence_id").count().where("count > 2").count() == 0
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got.where("doc_tokens < 3").collect()) == [(0, 1), (1, 1), (2, 2)]
    assert packing.pack_documents(d.limit(0), default_vocabulary()).count() == 0


def test_op8(spark, small):
    got = token_files.op8_arrow_token_files(spark, small).orderBy("doc_id").collect()
    e, at = PieceEncoder(default_vocabulary()), 0
    for r, d in zip(got, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = np.array(e.tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_sequences_across_batches():
    sink = io.BytesIO()
    w = token_files.SequenceWriter(sink, pa.uint16(), row=4, batch_rows=3)
    parts = [np.arange(i, dtype=np.uint32) for i in (0, 5, 1, 30, 2)]
    for p in parts:
        w.append(p)
    w.close()
    flat = np.concatenate(parts)
    r = token_files.SequenceReader(pa.BufferReader(sink.getvalue()))
    for a in range(len(flat)):
        for n in (0, 1, 7, len(flat) - a):
            assert (r.span(a, min(n, len(flat) - a)) == flat[a : a + min(n, len(flat) - a)]).all()
    assert r.sequence(1).tolist() == flat[4:8].tolist()


def test_op8_edges(spark):
    from loamgrid.llm._shared import scratch

    d = spark.createDataFrame([(3, None), (None, "n"), (1, "a"), (1, "a"), (2, "b c " * 9000)], "doc_id long, text string")
    uri = scratch(spark, "test")
    back = token_files.read_token_files(token_files.write_token_files(d, uri, default_vocabulary()), uri, "bigint").orderBy("start").collect()
    assert [r["id"] for r in back] == [None, 1, 1, 2, 3] and [r["start"] for r in back] == [0, 2, 4, 6, back[3]["start"] + back[3]["n_tokens"]]
    uri = scratch(spark, "test")
    assert token_files.read_token_files(token_files.write_token_files(d.limit(0), uri, default_vocabulary()), uri, "bigint").count() == 0
