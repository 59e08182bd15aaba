"""Unbounded n-gram scoring over sharded suffix arrays.

The corpus is written once to the shared folder, a file a task: word numbers, and the
64-bit hash of each number. Its suffix array - here of contexts, read backwards from
each word - is sharded by the hash of a context's last two words, so all contexts
that can match each other beyond them meet in one shard, whatever document they come
from. A shard receives pointers only; it sorts them by ever longer contexts and each
position, being a query too, is binary-searched into the narrowing intervals of
training contexts until its longest matching context is found. Interval counts of the
word that follows, summed over the shard's files, give the continuation estimate.

    p(w | context) = lam[k] * count(context w) / count(context) + (1 - lam[k]) * p2(w | v)
    p2(w | v) = (count(v w) + MU * p1(w)) / (count(v) + MU)

with the longest context that training text has, k its length (``CLASSES`` at most), v
the word before and p1 the add-one unigram. Pairs of words are counted like words, by
an aggregate, so a context of one word is known wherever any is. lam[k] is the hit rate
of contexts of that class over all training positions.

A training text is scored by the model of all other rows: its own words, pairs and
contexts are left out of every count, whether they occur in it once or often. So the
scores of training and of held-out rows say the same, and a text that another row
repeats stands out by its score.

Once all training continuations of a context of CLASSES words or more agree, longer
contexts agree too, so the search stops there without changing the estimate. Where
they keep disagreeing for ``DEEP`` words, the rest of the way is taken along paths: the
contexts of an interval are compared with one of them by hashes of their prefixes, so a
context of a hundred thousand words takes a few steps.

Equal texts of a file are stored once with a weight, so a group of copies, however
large, puts few positions into a shard.

64-bit hashes stand for words and contexts; two with one hash (about 3 in a million for
ten million distinct words) would count as one.
"""

from __future__ import annotations

import math
import mmap
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, fold_of, keeper, open_fs, read_table, scratch, slices, take_turn, written

CLASSES = 6
MU = 20.0
DEEP = 64
#: Files that a worker keeps: read into memory, or mapped, which costs address space alone (five maps a file).
OPEN_FILES, MAPPED_FILES = 32, 8000
#: Words that are read ahead of the search, and how many of one context at most.
AHEAD, AHEAD_DEPTHS = 3_000_000, 16
SHARD_WORDS = 1_200_000
BLOB_BYTES = 64 << 10
FILE_WORDS = 3_000_000
_UNIT = 1_000_000  # sums of shares travel as millionths
_END = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for i, r in enumerate((_R, inverse)):
            x = np.full(max(n, 1 << 16), r, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lowered text, in order."""
    a = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(a) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unpack(b: bytes, n: int, kind: str) -> np.ndarray:
    k = np.dtype(kind)
    return np.frombuffer(pa.decompress(b, n * k.itemsize, "zstd", asbytes=True), k) if n else np.zeros(0, k)


class _File:
    """One task's part of the corpus, memory-mapped where the folder is a local mount."""

    def __init__(self, uri: str, number: int):
        fs, path = open_fs(uri)
        self.mapped = fs.type_name == "local"
        load = (lambda k, t: np.frombuffer(_mapped(f"{path}/{number}.{k}"), t)) if self.mapped else (lambda k, t: np.frombuffer(fs.open_input_file(f"{path}/{number}.{k}").read(), t))
        self.words, self.hashes, self.starts = load("words", "<u4"), load("hashes", "<u8"), load("starts", "<i8")
        self.weight, self.rows = load("weight", "<u4"), load("rows", "<i4")


def _mapped(path: str) -> mmap.mmap:
    """The file's bytes, without a descriptor that stays open."""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)


_files: OrderedDict[tuple[str, int], _File] = OrderedDict()
keeper("ngrams", _files.clear)


def _file(uri: str, number: int) -> _File:
    """A file of the corpus, kept from shard to shard and from task to task: every shard has positions in every file."""
    if (got := _files.get((uri, number))) is None:
        got = _files[uri, number] = _File(uri, number)
        if len(_files) > (MAPPED_FILES if got.mapped else OPEN_FILES):
            _files.popitem(last=False)
    _files.move_to_end((uri, number))
    return got


def _save(uri: str, number: int, **arrays: np.ndarray) -> None:
    """Names depend on the task's number only and contents on its rows: another attempt writes the same."""
    fs, path = open_fs(uri)
    attempt = TaskContext.get().taskAttemptId()
    for k, a in arrays.items():
        with fs.open_output_stream(f"{path}/{number}.{k}.{attempt}") as out:
            out.write(np.ascontiguousarray(a).data if len(a) else b"\0")
        _settle(fs, f"{path}/{number}.{k}", attempt)


def _settle(fs, name: str, attempt: int) -> None:
    """Gives an attempt's file its name; where another attempt's has it and can't be replaced, that one is as good."""
    try:
        fs.move(f"{name}.{attempt}", name)
    except OSError:
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(f"{name}.{attempt}")


def _runs(ranked: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    first = np.empty(len(ranked), bool)
    first[:1], first[1:] = True, ranked[1:] != ranked[:-1]
    return np.flatnonzero(first)


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of non-negative keys, and the keys in it; values are sorted, in half the time of ``argsort``.

    A value is a key's leading bits with its place in the lower ones. Keys that agree in these bits and differ
    beyond are few among hashes, and sorted once more; small keys have room for all their bits.
    """
    keys = keys.view(np.uint64)
    bits = np.uint64(max(len(keys) - 1, 1).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    short = len(keys) > 0 and int(keys.max()) >> (64 - int(bits)) == 0
    value = keys << bits if short else keys & ~low
    value |= np.arange(len(keys), dtype=np.uint64)
    value.sort()
    order = (value & low).view(np.int64)
    ranked = keys[order]
    if short:
        return order, ranked
    mixed = np.flatnonzero((ranked[1:] ^ ranked[:-1]) - np.uint64(1) < low)
    if len(mixed) > 1000:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    lead = np.unique(value[mixed] & ~low)
    for a, b in zip(np.searchsorted(value, lead), np.searchsorted(value, lead | low, "right")):
        part = order[a:b]
        order[a:b] = part[np.argsort(keys[part], kind="stable")]
        ranked[a:b] = keys[order[a:b]]
    return order, ranked


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and which of them each key is."""
    order, ranked = _order(keys)
    start = _runs(ranked)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
    return ranked[start], which


def _shard_order(shard: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of 16 bits are sorted by radix."""
    return np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")


def _shard_of(last: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    return (mix(last + second * _R) >> np.uint64(33)).astype(np.int64) % shards


def _positions(words: np.ndarray, hashes: np.ndarray, starts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with two words before them in their text, ordered by shard, and the shards' bounds."""
    n = len(words)
    ok = np.ones(n, bool)
    ok[starts] = False
    ok[starts[starts + 1 < n] + 1] = False
    at = np.flatnonzero(ok)
    shard = _shard_of(hashes[words[at - 1]], hashes[words[at - 2]], shards)
    order = _shard_order(shard, shards)
    return at[order], np.searchsorted(shard[order], np.arange(shards + 1))


_SCHEMA = "kind int, shard int, file int, n long, m long, blob binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _batched(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BLOB_BYTES``, as a row a batch costs more than a small row; large batches would cost the JVM memory beside its heap."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[5] or b"")
        if size >= BLOB_BYTES or len(held) >= 4096:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _write_file(uri: str, number: int, held: list[tuple], shards: int) -> Iterator[tuple]:
    # equal texts of a file are one text with a weight, so a group of copies costs a text a file; held-out ones weigh nothing
    texts: dict[tuple[bytes, bool], int] = {}
    learn = np.array([x for _, train, _ in held for x in train], bool)
    rows = np.array([texts.setdefault((h.tobytes(), y), len(texts)) for _, train, parts in held for h, y in zip(parts, train)], np.int32)
    weight = np.bincount(rows[learn], minlength=len(texts)).astype(np.uint32)
    parts = [np.frombuffer(x, np.uint64) for x, _ in texts]
    size = np.array([len(h) for h in parts], np.int64)
    hashes, words = _distinct(np.concatenate(parts))
    del texts, parts
    words = words.astype(np.uint32)
    starts = np.cumsum(size) - size
    _save(uri, number, words=words, hashes=hashes, starts=starts, weight=weight, rows=rows)
    fs, path = open_fs(uri)
    attempt = TaskContext.get().taskAttemptId()
    table = pa.table({"id": pa.chunked_array([x for x, _, _ in held])})
    with fs.open_output_stream(f"{path}/{number}.ids.{attempt}") as sink, pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    _settle(fs, f"{path}/{number}.ids", attempt)
    counts = np.bincount(words, np.repeat(weight, size), len(hashes)).astype(np.uint32)
    at, bounds = _positions(words, hashes, starts, shards)
    order, cut = _word_shards(hashes, shards)
    pairs, pair = _pairs(words, hashes, starts)
    met = np.bincount(pair, np.repeat(weight, size)[1:], len(pairs)).astype(np.uint32)
    met_order, met_cut = _word_shards(pairs, shards)
    for s in range(shards):
        p, u, v = at[bounds[s] : bounds[s + 1]], order[cut[s] : cut[s + 1]], met_order[met_cut[s] : met_cut[s + 1]]
        if len(p):
            yield 0, s, number, len(p), 0, _pack(np.diff(p, prepend=0).astype("<u4"))
        if len(u):
            yield 1, s, number, len(u), int(counts[u].sum()), _pack(np.concatenate([np.diff(hashes[u], prepend=np.uint64(0)).view("<u4"), counts[u]]))
        if len(v):
            yield 6, s, number, len(v), 0, _pack(np.concatenate([np.diff(pairs[v], prepend=np.uint64(0)).view("<u4"), met[v]]))


def _pairs(words: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a word and the next one, and which of them ends at each word but the file's first; a text's first
    word makes no pair and has the last number, which is none of theirs."""
    if len(words) < 2:
        return np.zeros(1, np.uint64), np.zeros(0, np.int64)
    first = np.zeros(len(words), bool)
    first[starts] = True
    key = mix(hashes[words[:-1]] + mix(hashes[words[1:]] + _R)) >> np.uint64(1)
    key[first[1:]] = np.uint64((1 << 64) - 1)
    keys, which = _distinct(key)
    if keys[-1] != np.uint64((1 << 64) - 1):
        keys = np.append(keys, np.uint64((1 << 64) - 1))
    return keys, which


def _word_shards(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    part = (hashes >> np.uint64(33)).astype(np.int64) % shards
    order = _shard_order(part, shards)
    return order, np.searchsorted(part[order], np.arange(shards + 1))


def _write_corpus(docs: DataFrame, uri: str, shards: int) -> DataFrame:
    """docs (id, text, train) to files; rows: kind 0 pointers by shard, kind 1 word hashes and training counts by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 10  # room for a thousand files a task
        held: list[tuple] = []
        words = 0
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                texts = [np.append(word_hashes(raw or b""), _END) for raw in as_bytes(b.column("text"))]
                held.append((b.column("id"), b.column("train").to_pylist(), texts))
                words += sum(map(len, texts))
                if words >= FILE_WORDS:
                    yield from _batched(_write_file(uri, number, held, shards))
                    number, held, words = number + 1, [], 0
        if held:
            yield from _batched(_write_file(uri, number, held, shards))

    return docs.mapInArrow(run, _SCHEMA)


def _count_words(rows: list[tuple]) -> list[tuple]:
    """Kind 1 rows of one shard: back go each file's words' training counts (kind 3) and the distinct ones (kind 4); of kind 6 the pairs' counts (kind 7)."""
    each = []
    for _, shard, file, n, _, blob in rows:
        a = _unpack(blob, 3 * n, "<u4")
        each.append((shard, file, np.cumsum(a[: 2 * n].view("<u8"), dtype=np.uint64), a[2 * n :]))  # keys ascend
    keys, where = _distinct(np.concatenate([x[2] for x in each]))
    total = np.bincount(where, np.concatenate([x[3] for x in each]), len(keys)).astype(np.int64)
    single = rows[0][0] == 1
    out, at = [(4, each[0][0], -1, int((total > 0).sum()), int(total.sum()), None)] if single else [], 0
    for shard, file, h, _ in each:
        out.append((3 if single else 7, shard, file, len(h), 0, _pack(total[where[at : at + len(h)]].astype("<i8"))))
        at += len(h)
    return out


def _repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs among all."""
    order, ranked = _order(keys)
    n = np.diff(np.append(_runs(ranked), len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _counted(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of all keys that equal each key."""
    order, ranked = _order(keys)
    start = _runs(ranked)
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[order] = np.repeat(np.add.reduceat(weights[order], start), np.diff(np.append(start, len(keys))))
    return out


def _search(rows: list[tuple], files, deep: int = DEEP) -> list[tuple]:
    """Kind 0 rows of one shard: back go each file's results (kind 2) and the sums of training positions' shares by class (kind 5).

    A result is one byte: class * 4 + (0: no continuation agrees, 1: all do, 2: a share, listed after).
    """
    at = [np.cumsum(_unpack(r[5], r[3], "<u4").astype(np.int64)) for r in rows]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in at])])
    pos = np.concatenate(at)
    del at
    n = len(pos)
    before, weight, follows, text = np.empty(n, np.int32), np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    key = np.empty(n, np.uint64)
    for i, (r, a, b) in enumerate(zip(rows, edge, edge[1:])):
        f, p = files(r[2]), pos[a:b]
        d = np.searchsorted(f.starts, p, "right") - 1
        before[a:b], weight[a:b], text[a:b] = p - f.starts[d], f.weight[d], d + (i << 32)
        follows[a:b] = f.hashes[f.words[p]]
        key[a:b] = mix(f.hashes[f.words[p - 1]] + mix(f.hashes[f.words[p - 2]] + _R))
    share, kind = np.zeros(n, np.float32), np.zeros(n, np.uint8)

    def word(which: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The hash of the word ``depth`` places before each position."""
        order = np.argsort(which)  # positions ascend file by file
        ranked, depth = which[order], np.broadcast_to(depth, which.shape)[order]
        out = np.empty(len(which), np.uint64)
        for r, a, b in zip(rows, *(np.searchsorted(ranked, e) for e in (edge[:-1], edge[1:]))):
            if b > a:
                f = files(r[2])
                out[order[a:b]] = f.hashes[f.words[pos[ranked[a:b]] - depth[a:b]]]
        return out

    ahead, base, place = np.zeros((0, 0), np.uint64), 2, np.empty(n, np.int32)

    def next_words(which: np.ndarray, depth: int) -> np.ndarray:
        """As ``word``, for ever larger depths and ever fewer positions: one visit of the files serves several depths."""
        nonlocal ahead, base
        if depth > base + len(ahead):
            there = np.zeros(n, bool)
            there[which] = True
            ranked = np.flatnonzero(there)
            ahead = np.empty((max(1, min(AHEAD_DEPTHS, AHEAD // len(ranked))), len(ranked)), np.uint64)
            base = depth - 1
            place[ranked] = np.arange(len(ranked))
            for r, a, b in zip(rows, *(np.searchsorted(ranked, e) for e in (edge[:-1], edge[1:]))):
                if b > a:
                    f = files(r[2])
                    # past the start of a text, where none is asked for, any word will do
                    p = pos[ranked[a:b]] - depth - np.arange(len(ahead))[:, None]
                    ahead[:, a:b] = f.hashes[f.words[np.maximum(p, 0)]]
        return ahead[depth - 1 - base][place[which]]

    # contexts of two words; ``now`` is in suffix-array order and ``group`` numbers its intervals
    now, depth = np.arange(n), 2
    lone = np.zeros(n, bool)  # whose text has the context once: longer ones as well
    while len(now):
        order, key = _order(key)
        now = now[order]
        start = _runs(key)
        members = np.diff(np.append(start, len(key)))
        w = weight[now]
        # intervals without training text, or of one position, are done: what was found before holds
        stay = (np.add.reduceat(w, start) > 0) & (members > 1) | (np.maximum.reduceat(w, start) > 1)
        keep = np.repeat(stay, members)
        group = np.repeat(np.flatnonzero(stay).astype(np.uint64), members[stay])
        now, key, w = now[keep], key[keep], w[keep]
        if not len(now):
            break
        total, same, pure = _weigh(group, follows[now], w, text[now], now, lone)
        some = total > 0
        level = min(depth, CLASSES)
        share[now[some]], kind[now[some]] = same[some] / total[some], level
        # an interval goes on while anything in it still has a match
        live = np.zeros(int(group[-1]) + 1, bool)
        live[group.view(np.int64)[some]] = True
        go = live[group.view(np.int64)] & (before[now] > depth)
        if depth >= CLASSES:
            go &= ~pure
        now, key, group = now[go], key[go], group[go]
        if depth >= deep:
            _paths(now, group, depth, pos, before, weight, follows, text, share, kind, word, lambda i: files(rows[i][2]))
            break
        depth += 1
        key = mix(key + mix(next_words(now, depth) + np.uint64(depth * int(_R) & (1 << 64) - 1))) if len(now) else key
    left = np.zeros((CLASSES + 1, 2))
    for level in range(2, CLASSES + 1):
        mine = (kind == level) & (weight > 0)
        left[level] = float((share[mine] * weight[mine]).sum()), int(weight[mine].sum())
    out: list[tuple] = []
    for r, a, b in zip(rows, edge, edge[1:]):
        s = share[a:b]
        code = kind[a:b] * 4 + np.where(kind[a:b] == 0, 0, np.where(s >= 1, 1, np.where(s <= 0, 0, 2))).astype(np.uint8)
        part = s[code % 4 == 2]
        out.append((2, r[1], r[2], b - a, len(part), _pack(np.concatenate([code.view(np.uint8), np.ascontiguousarray(part, "<f4").view(np.uint8)]))))
    out += [(5, rows[0][1], i, int(c), int(s * _UNIT), None) for i, (s, c) in enumerate(left) if c]
    return out


def _weigh(group: np.ndarray, follows: np.ndarray, weight: np.ndarray, text: np.ndarray, now: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each position: the weight of its interval, that with its continuation - both without its own text, if that is learned
    from - and whether all training continuations of the interval agree. Marks those whose text is in the interval once."""
    g = group.view(np.int64)
    total = np.bincount(g, weight).astype(np.int64)[g]
    mine = weight > 0
    same = _counted(mix(group * _R + follows), weight)
    pure = np.zeros(int(g[-1]) + 1, bool)
    pure[g[mine & (same == total)]] = True
    total[mine] -= 1
    same[mine] -= 1
    often = np.flatnonzero(mine & ~lone[now])
    own = mix(group[often] * _R + mix(text[often]))
    n = _repeats(own)
    lone[now[often[n == 1]]] = True
    often, own, n = often[n > 1], own[n > 1], n[n > 1]
    total[often] -= n - 1
    same[often] -= _repeats(mix(own + follows[often])) - 1
    return total, same, pure[g]


def _paths(now, group, depth, pos, before, weight, follows, text, share, kind, word, file_of) -> None:
    """The rest of the search, for intervals whose continuations disagree at ``depth`` words.

    In every round each interval is compared with one of its contexts: how far a context
    goes along with it (by binary search over prefix hashes) says in which interval on
    that path its longest match lies. Contexts that leave the path together are the
    intervals of the next round.
    """
    # prefix hashes of the texts concerned
    texts, of = np.unique(text[now], return_inverse=True)
    base = np.zeros(len(texts), np.int64)
    sums, starts, used = [], np.zeros(len(texts), np.int64), 0
    for i, t in enumerate(texts.tolist()):
        f = file_of(t >> 32)
        d = t & 0xFFFFFFFF
        a, b = int(f.starts[d]), int(f.starts[d + 1]) if d + 1 < len(f.starts) else len(f.words)
        up, _ = _power(b - a + 1)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(f.hashes[f.words[a:b]]) * up[: b - a], dtype=np.uint64)]))
        base[i], starts[i] = a, used
        used += b - a + 1
    sums = np.concatenate(sums) if sums else np.zeros(0, np.uint64)
    longest = int(before[now].max()) + 1 if len(now) else 1
    up, down = _power(longest + 1)
    offset = np.zeros(len(pos), np.int64)
    offset[now] = starts[of] - base[of]  # where a position's prefix sum lies
    shift = np.zeros(len(pos), np.int64)
    shift[now] = base[of]

    def prefix(which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hash of the k words before each position."""
        end = pos[which]
        return (sums[end + offset[which]] - sums[end - k + offset[which]]) * down[end - k - shift[which]]

    depth = np.full(len(now), depth, np.int64)  # of each position's interval
    while len(now):
        _, g = np.unique(group, return_inverse=True)
        # the training context with most words before it leads
        order = np.lexsort((-before[now], weight[now] == 0, g))
        now, g, depth = now[order], g[order], depth[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        lead = now[start][g]
        low, high = depth.copy(), np.minimum(before[now], before[lead]).astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = prefix(now, mid) == prefix(lead, mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        along = low
        # the longest part of the path that another text goes along; copies of one's own text are other texts
        t, w, fol = text[now].astype(np.int64), weight[now], follows[now]
        other = np.where(w > 1, -np.arange(1, len(now) + 1), t)
        order = np.lexsort((-along, w == 0, g))
        top = order[np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))]
        best, whose = np.where(w[top] > 0, along[top], -1), other[top]
        second = np.full(len(top), -1)
        rest = (w > 0) & (other != whose[g])
        np.maximum.at(second, g[rest], along[rest])
        k = np.minimum(along, np.where(whose[g] == t, second[g], best[g]))
        known = k >= depth

        def weigh(label: np.ndarray, weights: np.ndarray) -> np.ndarray:
            """For each position the weights with its label that go along for k words or more."""
            names, number = np.unique(label, return_inverse=True)
            place = number.astype(np.int64) << 32
            has = weights > 0
            keys = place[has] + along[has]
            order = np.argsort(keys)
            run = np.concatenate([[0], np.cumsum(weights[has][order])])
            return run[np.searchsorted(keys[order], place + (1 << 32) - 1, "right")] - run[np.searchsorted(keys[order], place + np.maximum(k, 0), "left")]

        u = g.astype(np.uint64)
        ones = (w > 0).astype(np.int64)
        mine = np.where(w > 0, 1, 0)
        total = weigh(g, w) - mine * weigh(mix(u * _R + mix(t.astype(np.uint64))), ones)
        same = weigh(mix(u * _R + fol), w) - mine * weigh(mix(mix(u * _R + mix(t.astype(np.uint64))) + fol), ones)
        known &= total > 0
        share[now[known]], kind[now[known]] = same[known] / total[known], CLASSES
        # who leaves the path before its own text ends
        off = np.flatnonzero(before[now] > along)
        if not len(off):
            return
        nxt = word(now[off], along[off] + 1)
        group = mix(mix(u[off] * _R + along[off].astype(np.uint64)) + nxt)
        names, number, members = np.unique(group, return_inverse=True, return_counts=True)
        learned, copies = np.bincount(number, w[off]), np.zeros(len(names), np.int64)
        np.maximum.at(copies, number, w[off])
        stay = ((members > 1) & (learned > 0) | (copies > 1))[number]
        now, group, depth = now[off][stay], group[stay], along[off][stay] + 1


def _in_runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a partition sorted by ``columns``, one list for each value of them."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        at = [batch.schema.names.index(c) for c in columns]
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = tuple(row[i] for i in at)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def score_unbounded(df: DataFrame, text: str = "text", id_col: str = "doc_id", train: str = "train", *, shard_words: int = SHARD_WORDS, deep: int = DEEP) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    ``train`` (boolean, null: false) marks the rows that are learned from; ``score`` leaves
    such a row out of what it is scored by, ``base_score`` does not. A null or empty text
    is its end token alone. Repeated rows are learned from and scored each, and are known
    to each other. Without a training row every token is unknown. Other columns are not
    looked at. No row: no result.
    """
    spark = df.sparkSession
    uri = scratch(spark, "ngrams")
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    kind = src.schema["id"].dataType.simpleString()
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / 6 / shard_words))
    fs, path = open_fs(uri)

    fs.create_dir(f"{path}/corpus", recursive=True)
    sent = _write_corpus(src, f"{uri}/corpus", shards)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("ngrams")
        for rows in _in_runs(batches, ["kind", "shard"]):
            yield from _batched(_search(rows, lambda i: _file(f"{uri}/corpus", i), deep) if rows[0][0] == 0 else _count_words(rows))

    tasks = max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = written(sent.repartition(tasks, "kind", "shard").sortWithinPartitions("kind", "shard", "file").mapInArrow(work, _SCHEMA), f"{uri}/found")
    stats = got.where("kind = 4").agg(F.sum("n"), F.sum("m")).first()
    distinct, total = stats[0] or 0, stats[1] or 0
    lam = np.zeros(CLASSES + 1)
    for r in got.where("kind = 5").groupBy("file").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():  # a row a class
        lam[r["file"]] = min(0.98, r["m"] / _UNIT / (r["n"] + 2))
    unit = math.log10(total + distinct + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_runs(batches, ["file"]):
            number = rows[0][2]
            f = _File(f"{uri}/corpus", number)
            words, hashes, starts = np.asarray(f.words), np.asarray(f.hashes), np.asarray(f.starts)
            order, cut = _word_shards(hashes, shards)
            pairs, pair = _pairs(words, hashes, starts)
            met_order, met_cut = _word_shards(pairs, shards)
            at, bounds = _positions(words, hashes, starts, shards)
            seen, met = np.zeros(len(hashes), np.int64), np.zeros(len(pairs), np.int64)
            weight, share = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
            for what, shard, _, n, m, blob in rows:
                if what == 3:
                    seen[order[cut[shard] : cut[shard + 1]]] = _unpack(blob, n, "<i8")
                elif what == 7:
                    met[met_order[met_cut[shard] : met_cut[shard + 1]]] = _unpack(blob, n, "<i8")
                else:
                    raw = _unpack(blob, n + 4 * m, "u1")
                    code, q = raw[:n], (raw[:n] % 4 == 1).astype(np.float32)
                    q[code % 4 == 2] = raw[n:].view("<f4") if m else 0
                    p = at[bounds[shard] : bounds[shard + 1]]
                    weight[p], share[p] = lam[code // 4], q
            c = seen[words]
            base = np.log10(c + 1.0) - unit
            # what the text itself adds to the counts of words and pairs
            sizes = np.diff(np.append(starts, len(words)))
            doc = np.repeat(np.arange(len(starts)), sizes)
            learned = (np.asarray(f.weight) > 0)[doc]
            mine = np.where(learned, _repeats(doc * len(hashes) + words), 0)
            p = (c - mine + 1.0) / (total + distinct + 1.0 - np.where(learned, sizes[doc], 0))
            inner = np.ones(len(words), bool)
            inner[starts] = False
            i = np.flatnonzero(inner)
            both = met[pair[i - 1]]
            own = learned[i].astype(np.int64)
            often = np.flatnonzero(learned[i] & (both > 1))  # others are the text's own, once
            own[often] = _repeats(doc[i[often]] * len(pairs) + pair[i[often] - 1])
            p[i] = (both - own + MU * p[i]) / (c[i - 1] - mine[i - 1] + MU)
            score = np.log10(np.maximum(weight * share + (1 - weight) * p, 1e-300))
            n = np.diff(np.append(starts, len(words)))
            fs, path = open_fs(f"{uri}/corpus")
            with fs.open_input_file(f"{path}/{number}.ids") as source:
                ids = pa.ipc.open_file(source).read_all().column("id").combine_chunks()
            each = np.asarray(f.rows)
            sums = (n, np.add.reduceat((c > 0).astype(np.int64), starts), np.full(len(n), total), np.add.reduceat(base, starts), np.add.reduceat(score, starts))
            cols = [ids, *[pa.array(x[each]) for x in sums]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = got.where("kind in (2, 3, 7)").repartition(max(2, tasks // 2), "file").sortWithinPartitions("file")
    return back.mapInArrow(finish, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op4_unbounded_ngrams(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 7) != 2).alias("train"))
    out = score_unbounded(docs)
    return out.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
