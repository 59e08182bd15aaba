"""Helpers that the training-data operators share.

Nothing here keeps state between calls besides scratch folders, which live in
the folder that ``spark.checkpoint.dir`` names (shared by all executors) and go
when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker has in work at once, above the Arrow batch itself.
SLICE_BYTES = 4 << 20


_keepers: dict[str, Callable[[], None]] = {}


def keeper(name: str, clear: Callable[[], None]) -> None:
    """Names a cache that Python workers keep from task to task."""
    _keepers[name] = clear


def take_turn(name: str = "") -> None:
    """Called where an operator's task begins: a worker that served another operator lets go of that one's cache."""
    for k, clear in _keepers.items():
        if k != name:
            clear()


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it otherwise, in every idle worker beside its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def forget(cached: Callable) -> None:
    """Empties an ``lru_cache`` and returns its memory to the system."""
    if cached.cache_info().currsize:
        cached.cache_clear()
        gc.collect()
        give_back()


def in_turn(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: takes its turn first and gives back what it has freed when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, a new local one (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loamgrid-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def _drop(uri: str) -> None:
    try:
        fs, path = open_fs(uri)
        fs.delete_dir(path)
    except OSError:
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for one run of an operator; removed when the driver's Python ends."""
    uri = f"{shared_root(spark)}/loamgrid-{what}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    atexit.register(_drop, uri)
    return uri


def written(df: DataFrame, uri: str) -> DataFrame:
    """Cuts lineage: the table as written to the shared folder, read again."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)), F.lit(0).cast("bigint"))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    run = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = run[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(run, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of every row, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sample_by_label(df: DataFrame, label: str, id_col: str, per_label: int, most: int = 1000) -> DataFrame:
    """At most ``per_label`` rows of each non-null label, those with the smallest id hashes; ValueError beyond ``most`` labels.

    Two passes: label counts set a hash threshold for each label, so that only
    about twice the wanted rows reach the ranking; no label's rows meet in one task.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} values of {label}")
    if not counts:
        return df.where(F.lit(False))
    bits = 1 << 62
    keep = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(bits, int(bits * 2.0 * per_label / r["count"]) + 1))])
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2)
    from pyspark.sql import Window

    near = df.where(F.col(label).isNotNull()).withColumn("__h", h).where(F.col("__h") <= keep[F.col(label)])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__h", F.col(id_col)))
    return near.withColumn("__r", rank).where(F.col("__r") <= per_label).drop("__h", "__r")


def copied(column: pa.Array) -> pa.Array:
    """The values in memory of their own: keeping a column of a batch would keep the whole message."""
    return column.take(pa.array(np.arange(len(column))))


def attach(big: DataFrame, small: DataFrame, key: str, weight: str, spread: str, line: int | None = None) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row a key) that no hot key can stall.

    ``weight`` says how many rows of ``big`` have the key. Keys that hold over a
    thousandth of all rows - fewer than a thousand, whatever the size - are
    broadcast; the rest are joined by shuffle, where no key is large.
    With ``line``, keys of more rows than that are broadcast instead. ``spread`` scatters
    the rows that are already done; those are rows with a null key too, which match nothing.
    """
    value = [c for c in small.columns if c not in (key, weight)]
    if line is None:
        line = max(10_000, (small.agg(F.sum(weight)).first()[0] or 0) // 1000)
    hot = small.where(F.col(weight) > line).select(F.col(key), F.lit(True).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in value])
    cold = small.where(F.col(weight) <= line).select(F.struct(F.col(key).alias("k"), F.lit(None).cast("string").alias("s")).alias("__k"), *value).where(F.col("__k.k").isNotNull())
    done = F.coalesce(F.col("__hot"), F.lit(False)) | F.col(key).isNull()
    out = big.join(F.broadcast(hot), key, "left")
    out = out.withColumn("__k", F.struct(F.when(~done, F.col(key)).alias("k"), F.when(done, F.col(spread).cast("string")).alias("s")))
    on = out["__k"]["k"].eqNullSafe(cold["__k"]["k"]) & out["__k"]["s"].eqNullSafe(cold["__k"]["s"])
    out = out.join(cold, on, "left").drop("__k")
    for c in value:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}"))).drop(f"__{c}")
    return out.drop("__hot")
