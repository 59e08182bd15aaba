"""Token ids in the Arrow file format: fixed-size-list batches of equal-length sequences and masks.

A file holds consecutive ids as rows of ``ROW`` ids (column ``ids``) with a mask
(column ``mask``) that is false only where the last row is filled up. All values lie
in one buffer a batch, so a memory-mapped reader takes any sequence, or any span of
ids, without copying. A second Arrow file lists the documents (doc_id, start within
the file, number of ids).

Documents are range-partitioned by id; a file is one range in ascending order, and a
file's first global position is the sum of the ids before it, from the per-file counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import copied, open_fs, read_table, scratch, slices, take_turn, written
from .tokens import default_vocabulary, encoder

ROW = 2048
BATCH_ROWS = 512
FILE_BYTES = 128 << 20


def _narrowest(vocabulary_size: int) -> pa.DataType:
    return pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Appends ids; full batches go out at once, so memory is one batch."""

    def __init__(self, sink, kind: pa.DataType, row: int = ROW, batch_rows: int = BATCH_ROWS):
        self.kind, self.row, self.batch = kind, row, batch_rows * row
        self.schema = pa.schema([("ids", pa.list_(kind, row)), ("mask", pa.list_(pa.bool_(), row))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.batch:
            flat = np.concatenate(self.held)
            full = len(flat) // self.batch * self.batch
            for i in range(0, full, self.batch):
                self._batch(flat[i : i + self.batch], self.batch)
            self.held, self.waiting = [flat[full:].copy()], len(flat) - full

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.row), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.row)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.row, flat.dtype)]), len(flat))
        self.writer.close()


class SequenceReader:
    """Random access to a file's sequences and spans; nothing is copied where the source is memory-mapped."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.row = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None
        self.starts = None

    def _ids(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.batch = i, self.file.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.batch

    def span(self, start: int, n: int) -> np.ndarray:
        """The ids at [start, start + n), across batches if need be."""
        if not n:
            return np.zeros(0, np.uint16)
        per = len(self._ids(0)) if self.at != 0 or self.starts is None else self.starts
        self.starts = per
        first, last = start // per, (start + n - 1) // per
        parts = [self._ids(i)[max(0, start - i * per) : start + n - i * per] for i in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sequence(self, i: int) -> np.ndarray:
        return self.span(i * self.row, self.row)


def write_token_files(df: DataFrame, uri: str, vocabulary: str, *, end_id: int = 2, files: int | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the ids of every row in ascending id order; returns the written list (file, path, docs, ids).

    Nulls sort first; rows with one id come one after the other, in the order of their
    texts' hashes, over as many files as they need. A file has about ``FILE_BYTES`` of
    text, less where that would leave cores idle. A null or empty text is the end id
    alone; an empty table writes no file; other columns are not looked at.
    The list names complete files only: a second attempt at a task writes others.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if not files:
        size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES), min(4 * spark.sparkContext.defaultParallelism, -(-size // (FILE_BYTES // 16))))
    # the last column splits equal rows, which have no order
    keyed = src.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(files, "id", "h", "n").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("tokens")
        enc = encoder(vocabulary)
        task = TaskContext.get()
        fs, path = open_fs(uri)
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out = None
        docs: list[pa.Array] = []
        starts: list[int] = []
        sizes: list[int] = []
        for batch in batches:
            for b in slices(batch):
                if out is None:
                    sink = fs.open_output_stream(name + ".arrow")
                    out = SequenceWriter(sink, _narrowest(enc.tokenizer.get_vocab_size()))
                docs.append(copied(b.column("id")))
                for ids in enc.encode([x or "" for x in b.column("text").to_pylist()]):
                    ids = np.append(ids, np.uint32(end_id))
                    starts.append(out.total)
                    sizes.append(len(ids))
                    out.append(ids)
        if out:
            out.close()
            sink.close()
            table = pa.table({"id": pa.chunked_array(docs), "start": pa.array(starts, pa.int64()), "n": pa.array(sizes, pa.int64())})
            with fs.open_output_stream(name + ".index") as sink, pa.ipc.new_file(sink, table.schema) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name]), pa.array([len(starts)], pa.int64()), pa.array([out.total], pa.int64())], names=["file", "path", "docs", "ids"])

    return written(ordered.mapInArrow(run, "file long, path string, docs long, ids long"), uri + "-list")


def read_token_files(listing: DataFrame, uri: str, id_type: str) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens and ids_crc32, from the files of the list; no file, no rows."""
    base = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    files = listing.select("path", F.coalesce(base, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(uri)
        local = fs.type_name == "local"
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with pa.memory_map(path + ".arrow") if local else fs.open_input_file(path + ".arrow") as source, fs.open_input_file(path + ".index") as at:
                    ids = SequenceReader(source)
                    for b in pa.ipc.open_file(at).read_all().to_batches(10_000):
                        start, n = b.column("start").to_numpy(), b.column("n").to_numpy()
                        crc = [zlib.crc32(ids.span(s, k).astype("<u4")) for s, k in zip(start.tolist(), n.tolist())]
                        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(start + first), b.column("n"), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, listing.count())).mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def op8_arrow_token_files(spark, sf_dir: str) -> DataFrame:
    """Null texts are the end id alone; repeated rows are written each; an empty table writes no file."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    uri = scratch(spark, "tokens")
    out = read_token_files(write_token_files(docs, uri, default_vocabulary()), uri, docs.schema["doc_id"].dataType.simpleString())
    return out.withColumnRenamed("id", "doc_id")
