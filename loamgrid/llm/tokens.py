"""Whole-text encoding with the tokenizers library, faster by encoding each distinct word once.

A byte-level BPE splits a text into words before it merges: a space between two
other characters always starts a new word there, and a line feed between two others
is a word itself. So a text whose white space is single spaces and line feeds is cut
at them, each distinct piece is encoded by the library once, and the ids are joined;
any other text is encoded by the library as it is. The ids are the same (tested).
For the same reason many pieces can be given to the library as one text, and its ids
are cut where a token begins with a space, or is the line feed.
"""

from __future__ import annotations

import os
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import forget, keeper

#: Pieces that an encoder remembers; when they are more, the half that was met most often stays.
CACHE = 500_000


_LINE, _BARE = "\x01", "\x02"
_CUT = f" {_LINE} {_BARE}"
_SHORT = frozenset(("", _LINE, _BARE))
_MARKS = ".,;:!?%&*#$|"
#: White space in a row, white space of other kinds, and the two marks.
_UNSAFE = ("  ", "\n\n", " \n", "\n ", _LINE, _BARE, *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class _Index(dict):
    """Piece to number; a piece met for the first time gets the next number and waits to be encoded."""

    __slots__ = ("waiting",)

    def __missing__(self, piece: str) -> int:
        self.waiting.append(piece)
        n = self[piece] = len(self)
        return n


class PieceEncoder:
    """Pieces are kept without the space that starts them; a piece that has none (first in its line) is kept after ``_BARE``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A text that holds an added token is left to the library as well.
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.unsafe = (*_UNSAFE, *self.added)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Tokens that begin with a space, and the line feed: "Ġ" and "Ċ" stand for them in a byte-level vocabulary.
        self.spaced, self.line = (np.zeros(max(names.values(), default=0) + 1, bool) for _ in range(2))
        self.spaced[[n for x, n in names.items() if x[0:1] == "\u0120"]] = True
        self.line[[n for x, n in names.items() if x == "\u010a"]] = True
        self.parts: dict[str, bool] = {}
        self.index = _Index()
        self.index.waiting = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def _room(self, ids: int) -> None:
        if ids > len(self.flat):
            self.flat = np.resize(self.flat, max(ids, 2 * len(self.flat)))
        if len(self.index) > len(self.start):
            size = max(len(self.index), 2 * len(self.start))
            self.start, self.size = np.resize(self.start, size), np.resize(self.size, size)
            self.met = np.concatenate([self.met, np.zeros(size - len(self.met), np.int64)])

    def _parts(self, c: str) -> bool:
        """Whether the pre-tokenizer cuts between this character and a mark: behind letters and digits, not in a run of marks."""
        if c not in self.parts:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.parts[c] = len(cut(c + ".")) > len(cut(c))
        return self.parts[c]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes the pieces that were numbered last; a word whose last letter or digit is followed by marks is put together from the word and the marks."""
        index = self.index
        at = np.arange(len(index) - len(pieces), len(index))
        ends = [len(x.rstrip(_MARKS)) for x in pieces]
        joint = np.fromiter((1 < n < len(x) and self._parts(x[n - 1]) for x, n in zip(pieces, ends)), bool, len(pieces))
        words, marks = [index[x[:n]] for x, n, j in zip(pieces, ends, joint) if j], [index[_BARE + x[n:]] for x, n, j in zip(pieces, ends, joint) if j]
        alone = [x for x, j in zip(pieces, joint) if not j] + index.waiting
        number = np.concatenate([at[~joint], np.arange(len(index) - len(index.waiting), len(index))])
        index.waiting = []
        kind = np.fromiter((2 if x in _SHORT else x[0] == _BARE for x in alone), np.int8, len(alone))
        for k, mark in enumerate((" ", "\n", "")):
            which = np.flatnonzero(kind == k)
            for i in range(0, len(which), 20_000):
                mine = [alone[j] for j in which[i : i + 20_000].tolist()]
                ids, sizes = self._encoded(mine, mark)
                self._room(self.used + len(ids))
                self.flat[self.used : self.used + len(ids)] = ids
                self.start[number[which[i : i + 20_000]]] = self.used + np.cumsum(sizes) - sizes
                self.size[number[which[i : i + 20_000]]] = sizes
                self.used += len(ids)
        if words:
            both = np.column_stack([words, marks])
            ids = self._gather(both.ravel())
            self._room(self.used + len(ids))
            sizes = self.size[both].sum(1)
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[at[joint]] = self.used + np.cumsum(sizes) - sizes
            self.size[at[joint]] = sizes
            self.used += len(ids)

    def _encoded(self, pieces: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and how many each has. ``mark``: the character between them in a joint
        text, a space for pieces that a space starts, a line feed for those that have none; empty where there is none to go by."""
        joined = " " + " ".join(pieces) if mark == " " else "\n".join([x[1:] for x in pieces])
        if mark and not any(x in joined for x in self.added):
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero((self.spaced if mark == " " else self.line)[ids])
            if mark == " " and len(at) == len(pieces) and at[0] == 0:
                return ids, np.diff(np.append(at, len(ids)))
            if mark == "\n" and len(at) == len(pieces) - 1:
                return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast([x[1:] if x[0:1] == _BARE else "\n" if x == _LINE else " " + x for x in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.size[at]
        end = np.cumsum(n)
        return self.flat[np.arange(int(end[-1])) + np.repeat(self.start[at] - (end - n), n)]

    def _prune(self) -> None:
        stay = np.sort(np.argsort(-self.met[: len(self.index)], kind="stable")[: CACHE // 2])
        self.flat = self._gather(stay)
        self.size, self.met = self.size[stay], self.met[stay] // 2
        self.start = np.cumsum(self.size) - self.size
        self.used = len(self.flat)
        names = list(self.index)
        self.index = _Index(zip(map(names.__getitem__, stay.tolist()), range(len(stay))))
        self.index.waiting = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if len(self.index) > CACHE:
            self._prune()
        safe = [bool(t) and not any(x in t for x in self.unsafe) for t in texts]
        cut = pc.split_pattern(pa.array([_BARE + t.replace("\n", _CUT) for t, y in zip(texts, safe) if y], pa.large_string()), " ")
        met = cut.flatten().dictionary_encode()
        distinct = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        # a piece is looked up once for all texts, and new ones are numbered as they are met
        found = list(map(self.index.get, distinct))
        new = [x for x, n in zip(distinct, found) if n is None]
        number = np.array(found, np.float64)
        number[np.isnan(number)] = np.arange(len(self.index), len(self.index) + len(new))
        number = number.astype(np.int64)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self._learn(new)
        self._room(self.used)
        at = np.asarray(met.indices)
        self.met[number] += np.bincount(at, minlength=len(number))
        at, bounds = number[at], iter(np.asarray(cut.offsets).tolist())
        start = next(bounds)
        out: list[np.ndarray] = []
        for t, y in zip(texts, safe):
            if not y:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], np.uint32))
                continue
            end = next(bounds)
            out.append(self._gather(at[start:end]))
            start = end
        return out


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


keeper("tokens", partial(forget, encoder))


def default_vocabulary() -> str:
    """The byte-level BPE vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
