"""Secret scans: keyword automaton, anchored expressions at its hits, checksums.

An Aho-Corasick automaton over the lower-cased bytes finds every keyword in one
pass; only at its hits is an expression tried, anchored there, so texts without a
keyword never meet one. Bare hexadecimal runs have no keyword and are found by
their own run scan. Kinds that carry a checksum (GitHub-style tokens with CRC32 in
base 62, card numbers with Luhn, IBANs with mod 97) count only if it holds.

Card numbers and IBANs count if they begin within ``NEAR`` bytes behind a keyword, or
behind another one that did; numbers without a keyword nearby are left alone. Every
candidate there is tried whole and cut short at its blanks, so neither a number that
fails its checksum nor a group behind it hides one that holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, in_turn, slices, take_turn

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "iban", "card")
KEYWORDS = {b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign", b"apikey": "assign", b"api_key": "assign", b"akia": "access", **{b"gh" + bytes([c]) + b"_": "github" for c in b"pousr"}, b"iban": "iban", b"card": "card", b"visa": "card", b"mastercard": "card"}
NEAR, LONGEST = 48, 64  # bytes after a keyword within which an IBAN or card number begins; more than any of them has
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def github_checksum(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0").encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = (d - 48) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_holds(x: bytes) -> bool:
    x = x.replace(b" ", b"")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in (x[4:] + x[:4]).decode())) % 97 == 1


def _numbers(raw: bytes, kind: str, at: int) -> Iterator[tuple[int, int]]:
    """Spans of the card numbers or IBANs that begin near ``at`` and hold their checksum."""
    pattern, holds = (IBAN, iban_holds) if kind == "iban" else (CARD, lambda x: luhn(re.sub(rb"[\x20-]", b"", x)))
    least, limit = (15 if kind == "iban" else 13), at + NEAR
    while (m := pattern.search(raw, at, limit + LONGEST)) and m.start() < limit:
        ends = [m.end(), *(m.start() + x.start() for x in reversed([*re.finditer(rb"[\x20-]", m[0])]))]
        end = next((e for e in ends if sum(c not in b" -" for c in raw[m.start() : e]) >= least and holds(raw[m.start() : e])), None)
        if end is None:
            at = m.start() + 1
        else:
            yield m.start(), end
            at, limit = end, end + NEAR


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, kind in KEYWORDS.items():
        a.add_word(k.decode("latin-1"), (len(k), kind))
    a.make_automaton()
    return a


def byte_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS), in bytes, sorted by start and kind."""
    out: set[tuple[int, int, int]] = set()
    done = dict.fromkeys(KINDS, 0)
    for last, (n, kind) in _automaton().iter(raw.lower().decode("latin-1")):
        at = last - n + 1
        if at < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(raw, at):
                done[kind] = m.end()
                if len(m[2]) >= 6:
                    out.add((at, m.end(), 0))
        elif kind == "access":
            if m := ACCESS.match(raw, at):
                done[kind] = m.end()
                if m.end() - at >= 20:
                    out.add((at, m.end(), 1))
        elif kind == "github":
            if (m := GITHUB.match(raw, at)) and github_checksum(m[1]) == m[2]:
                done[kind] = m.end()
                out.add((at, m.end(), 3))
        else:
            out |= {(a, b, KINDS.index(kind)) for a, b in _numbers(raw, kind, last + 1)}
    out |= {(m.start(), m.end(), 2) for m in HEX.finditer(raw)}
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def code_point_spans(raw: bytes) -> list[tuple[int, int, int]]:
    spans = byte_spans(raw)
    if spans and not raw.isascii():
        point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spans = [(int(point[a]), int(point[b]), k) for a, b, k in spans]
    return spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: counts of the base kinds, all spans (code points, end exclusive) and a digest of the base ones.

    A null text counts as empty: no span, the digest of nothing. Repeated rows
    are answered each; a null id stays null.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn()
        for batch in batches:
            for b in slices(batch):
                rows = []
                for raw in as_bytes(b.column("text")):
                    spans = code_point_spans(raw or b"")
                    n = [sum(k == i for _, _, k in spans) for i in range(3)]
                    rows.append((*n, sha256(_joined([s for s in spans if s[2] < 3]).encode()).hexdigest(), _joined(spans)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(raw: bytes, mask: bytes = b"[secret]") -> bytes:
    """The text with every span masked; overlapping spans become one mask."""
    out, at = [], 0
    for a, b, _ in byte_spans(raw):
        if a >= at:
            out += [raw[at:a], mask]
        at = max(at, b)
    return b"".join(out) + raw[at:]


def redact_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Every row with its secrets masked and, if there is such a column, its length set anew; null stays null."""
    schema = docs.schema
    names = [f.name for f in schema]
    at, size = names.index(text), names.index(chars) if chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                old = as_bytes(b.column(at))
                new = [None if x is None else redact(x) for x in old]
                cols = list(b.columns)
                cols[at] = pa.array([None if x is None else x.decode() for x in new], b.schema.field(at).type)
                if size is not None:
                    cols[size] = pa.array([n if x == y else len(y.decode()) for n, x, y in zip(cols[size].to_pylist(), old, new)], b.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(in_turn(run), schema)


def op9_anchored_secrets(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return scan_secrets(read_table(spark, sf_dir, "documents"))
