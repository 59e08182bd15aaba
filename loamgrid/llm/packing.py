"""Vector bin packing of token pieces into sequences.

An example - a document, or the turns of a conversation - is cut where it fills a
sequence; what is left is packed by the dot-product heuristic: of the pieces that still fit the open sequence, the one whose
demand vector (tokens, segments, loss-bearing tokens, each as a share of its limit)
has the largest product with what is left of every limit goes in next.

Every task packs the rests of its own rows, ``WINDOW`` at a time, as it encodes them,
so nothing is shuffled and no key can be hot; a window leaves at most a few
sequences short.

Which tokens bear loss is told by the parts of an example: in instruction data those of
the assistant's turns, in plain documents all of them, so there the limits on tokens and
segments are the ones that bind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SLICE_BYTES, in_turn, read_table
from .tokens import default_vocabulary, encoder

WINDOW = 8192


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 16
    loss: int = 2048


def dot_product_bins(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Indices of the pieces of each sequence. A piece beyond a limit on its own is refused (ValueError).

    Pieces of equal demand are alike, so the search runs over distinct demands; ties
    go to the larger demand that sorts last, and equal pieces are used in order.
    """
    if not len(tokens):
        return []
    if tokens.max() > limits.tokens or loss.max() > limits.loss or tokens.min() < 1:
        raise ValueError("a piece doesn't fit an empty sequence")
    kinds, which = np.unique(np.column_stack([tokens, loss]), axis=0, return_inverse=True)
    members = np.argsort(which.ravel(), kind="stable")
    left = np.bincount(which.ravel(), minlength=len(kinds))
    used = np.concatenate([[0], np.cumsum(left)[:-1]])
    cap = np.array([limits.tokens, limits.loss, limits.segments], np.float64)
    demand = np.column_stack([kinds, np.ones(len(kinds))]) / cap
    t, z = kinds[:, 0], kinds[:, 1]
    alive = np.arange(len(kinds))
    out: list[list[int]] = []
    while len(alive):
        room_t, room_z, room_s, mine = limits.tokens, limits.loss, limits.segments, []
        while room_s:
            # alive is sorted by tokens: only a prefix can fit
            fit = alive[: np.searchsorted(t[alive], room_t, "right")]
            fit = fit[(z[fit] <= room_z) & (left[fit] > 0)]
            if not len(fit):
                break
            rest = np.array([room_t, room_z, room_s]) / cap
            k = fit[len(fit) - 1 - int(np.argmax((demand[fit] @ rest)[::-1]))]
            mine.append(int(members[used[k]]))
            used[k] += 1
            left[k] -= 1
            room_t, room_z, room_s = room_t - t[k], room_z - z[k], room_s - 1
        out.append(mine)
        alive = alive[left[alive] > 0]
    return out


def cuts(loss: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an example, each as long as both limits allow; ``loss`` has a flag a token."""
    if len(loss) <= min(limits.tokens, limits.loss):
        return [(0, len(loss))]
    run = np.cumsum(loss)
    out, at = [], 0
    while at < len(loss):
        done = int(run[at - 1]) if at else 0
        end = min(at + limits.tokens, int(np.searchsorted(run, done + limits.loss, "right")))
        out.append((at, end))
        at = end
    return out


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary()), ("loss_mask", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_TYPES = {pa.int64(): "long", pa.binary(): "binary"}


def pack_examples(df: DataFrame, vocabulary: str, parts: str, id_col: str = "doc_id", *, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Per piece: id, start, length, loss_tokens, ids, loss_mask, doc_tokens, sequence_id and offset.

    ``parts``: array of (text, loss); the ids of an example are those of its parts, each
    encoded apart, then ``end_id``, which bears loss as the last part does. ``ids`` are
    little-endian unsigned 32-bit integers, ``loss_mask`` a byte a token, null where all
    bear loss. Each id lies in exactly one piece. A null or empty array, or null or empty
    texts, are the end id alone. Repeated rows are packed each; a null id stays null.
    Other columns are not looked at. sequence_id is unique: the task's number and a count
    within it. An empty table gives no rows.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(parts).alias("parts"))
    if limits.loss < 1 or limits.segments < 1:
        raise ValueError("limits are 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        kind = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, k) for c, (_, k) in zip(cols[1:], _FIELDS)]], names=["id", *[n for n, _ in _FIELDS]])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, rests
            done = []
            for bin_ in dot_product_bins(np.array([r[2] for r in rests], np.int64), np.array([r[3] for r in rests], np.int64), limits):
                at = 0
                for i in bin_:
                    done.append((*rests[i], sequence, at))
                    at += rests[i][2]
                sequence += 1
            rests = []
            for i in range(0, len(done), 1024):
                yield rows(done[i : i + 1024])

        for batch in batches:
            kind = batch.schema.field("id").type
            for b in _by_size(batch):
                lists = b.column("parts")
                flat = lists.flatten()
                texts, marks = flat.field("text").to_pylist(), flat.field("loss").to_pylist()
                got = enc.encode([x or "" for x in texts])
                full, at = [], 0
                for doc, n in zip(b.column("id").to_pylist(), pc.fill_null(pc.list_value_length(lists), 0).to_pylist()):
                    mine, flags = got[at : at + n], [bool(x) for x in marks[at : at + n]] or [True]
                    at += n
                    ids = np.concatenate([*mine, np.array([end_id])]).astype("<u4")
                    loss = None if all(flags) else np.repeat(np.array([*flags, flags[-1]]), [*map(len, mine), 1] if mine else [0, 1])
                    for a, z in cuts(np.ones(len(ids), bool) if loss is None else loss, limits):
                        bears = z - a if loss is None else int(loss[a:z].sum())
                        row = (doc, a, z - a, bears, ids[a:z].tobytes(), None if bears == z - a else loss[a:z].tobytes(), len(ids))
                        if z - a == limits.tokens:
                            full.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            rests.append(row)
                if full:
                    yield rows(full)
                if len(rests) >= WINDOW:
                    yield from flush()
        yield from flush()

    out = src.mapInArrow(in_turn(run, "tokens"), f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {_TYPES[k]}" for n, k in _FIELDS))
    return out.withColumnRenamed("id", id_col)


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose parts hold at most ``SLICE_BYTES`` of text, one row at least."""
    lists = batch.column("parts")
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(lists.flatten().field("text")), 0)).astype(np.int64))])
    run = size[np.cumsum(n)]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack_documents(df: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", *, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """``pack_examples`` of documents, all of whose tokens bear loss."""
    one = F.array(F.struct(F.col(text).alias("text"), F.lit(True).alias("loss")))
    return pack_examples(df.select(id_col, one.alias("__parts")), vocabulary, "__parts", id_col, end_id=end_id, limits=limits)


def conversation_examples(turns: DataFrame, most_turns: int = 64) -> DataFrame:
    """(conv_id, part, parts): a conversation's turns in order, the assistant's bearing loss.

    ``turns``: conv_id, turn, role, text. An example has the turns of one stretch of
    ``most_turns`` turn numbers (``part``), so no conversation, however long, has to meet
    in one task. Ties of a turn number go by role and text; null texts are empty.
    """
    t = F.struct("turn", "role", "text")
    got = turns.groupBy("conv_id", F.floor(F.col("turn") / most_turns).alias("part")).agg(F.sort_array(F.collect_list(t)).alias("t"))
    return got.select("conv_id", "part", F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["role"].eqNullSafe("assistant").alias("loss"))).alias("parts"))


def op7_vector_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def packed_conversations(spark, sf_dir: str) -> DataFrame:
    """Instruction data under three limits: 2048 tokens, 8 segments and 1024 loss-bearing tokens a sequence."""
    out = pack_examples(conversation_examples(read_table(spark, sf_dir, "conversations")), default_vocabulary(), "parts", "conv_id", limits=Limits(2048, 8, 1024))
    return out.select("conv_id", "start", "length", "loss_tokens", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
