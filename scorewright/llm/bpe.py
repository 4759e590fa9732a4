"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts each text into chunks, so a passage shared by many documents falls into the same
chunks wherever it stands. A chunk is encoded once per Python worker and then reused. Encoded alone its ends are
wrong: the join of two chunks is encoded again over a window that widens, through whole chunks if need be, until both
its edges are safe points, where the joint and the separate encodings agree exactly.

A safe point lies before a space that follows a visible ASCII character: every pre-token with that character ends
there, the space begins the next, look-ahead never looks back, and no added token holds a space.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import worker_tables

#: Bytes the rolling hash sees, and mean bytes of a chunk.
ROLL_BYTES = 16
CHUNK_BYTES = 256
#: Entries kept per Python worker; what a full table drops is encoded again when met.
KEPT_UNITS = 400_000
KEPT_CHUNKS = 40_000
#: Longer units are encoded but not kept.
UNIT_BYTES = 64
ENCODE_AT_ONCE = 4096
ROWS_AT_ONCE = 500

_SAFE = re.compile(rb"(?<=[!-~])(?= )")
_MULTIPLIER = 0x9E3779B97F4A7C15


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Units:
    """Ids, as little-endian 32-bit numbers, of pieces of text that tokenize independently of their neighbours."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Makes every piece known; returns those that are not kept, being too long or too many."""
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if len(known) + len(new) > KEPT_UNITS:
            # the pieces met first are the most frequent ones
            self.known = known = dict(islice(known.items(), KEPT_UNITS // 2))
            new = [p for p in set(pieces) if p not in known]
        once = {}
        for i in range(0, len(new), ENCODE_AT_ONCE):
            part = new[i : i + ENCODE_AT_ONCE]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                (known if len(piece) <= UNIT_BYTES and len(known) < KEPT_UNITS else once)[piece] = array("I", e.ids).tobytes()
        return once

    def all_ids(self, lists: list[list[bytes]]) -> list[bytes]:
        """Ids of each list's pieces. New pieces of all lists are encoded in one call: a call costs as much as many pieces."""
        once = self.learn([p for pieces in lists for p in pieces])
        known = self.known
        if once:
            return [b"".join([known[p] if p in known else once[p] for p in pieces]) for pieces in lists]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]


class Chunks:
    """Content-defined cuts and the chunks encoded so far."""

    def __init__(self, units: Units, mean_bytes: int = CHUNK_BYTES):
        self.units = units
        self.mask = np.uint64(2 ** max(1, (mean_bytes - 1).bit_length()) - 1)
        self.known: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.powers = np.ones(1, np.uint64)
        self.table = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)

    def cuts(self, data: bytes) -> list[int]:
        """Positions to cut at, between characters, where the hash of the ROLL_BYTES before has its low bits clear."""
        n = len(data)
        if n <= ROLL_BYTES:
            return []
        if len(self.powers) < ROLL_BYTES:
            self.powers = np.cumprod(np.full(ROLL_BYTES, _MULTIPLIER, np.uint64))
        b = np.frombuffer(data, np.uint8)
        t = self.table[b]
        h = np.zeros(n - ROLL_BYTES, np.uint64)
        for k in range(ROLL_BYTES):
            h += t[k : n - ROLL_BYTES + k] * self.powers[k]
        hit = ((h >> np.uint64(24)) & self.mask) == 0
        hit &= (b[ROLL_BYTES:] & 0xC0) != 0x80
        return (np.flatnonzero(hit) + ROLL_BYTES).tolist()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [[t[a:b] for a, b in zip(at, at[1:], strict=False)] for t in texts for at in [[0, *self.cuts(t), len(t)]]]
        needed = {c for chunks in cut for c in chunks}
        fresh: dict[bytes, list[bytes]] = {c: [] for chunks in cut for c in chunks if c not in self.known}
        over = len(self.known) + len(fresh) - KEPT_CHUNKS
        if over > 0:
            # the oldest go, a quarter of the table at least, and none that this call reads
            for c in [c for c in self.known if c not in needed][: max(over, KEPT_CHUNKS // 4)]:
                del self.known[c]
        for c in fresh:
            fresh[c] = _SAFE.split(c)
        # what lies outside a chunk's first and last safe point waits for its neighbours
        inner = self.units.all_ids([pieces[1:-1] for pieces in fresh.values()])
        for (c, pieces), ids in zip(fresh.items(), inner, strict=True):
            self.known[c] = (pieces[0], ids, pieces[-1]) if len(pieces) > 1 else None
        inside: list[list[bytes]] = []
        joins: list[list[bytes]] = []
        for chunks in cut:
            inside.append([])
            window = b""
            for c in chunks:
                x = self.known[c]
                if x is None:
                    window += c  # no safe point: the window widens through the chunk
                    continue
                # at a join a safe point can appear that neither chunk shows alone; the window then is several pieces
                joins.append(_SAFE.split(window + x[0]))
                inside[-1].append(x[1])
                window = x[2]
            joins.append(_SAFE.split(window))
        mended = iter(self.units.all_ids(joins))
        return [b"".join([b"".join([next(mended), ids]) for ids in parts]) + next(mended) for parts in inside]


def _kept(key: tuple, make: Callable[[], object]):
    """The worker's one object of this key; workers serve many tasks."""
    tables = worker_tables("bpe")
    if key not in tables:
        tables[key] = make()
    return tables[key]


def units(path: str) -> Units:
    """The worker's known pieces."""
    return _kept(("units", path), lambda: Units(path))


def encoder(path: str, mean_bytes: int = CHUNK_BYTES) -> Chunks:
    """The worker's encoder; its chunks are shared across tasks."""
    return _kept(("chunks", path, mean_bytes), lambda: Chunks(units(path), mean_bytes))


def pieces_of_bytes(path: str) -> list[bytes]:
    """The bytes each id stands for.

    Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    added = {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    size = max([*model["model"]["vocab"].values(), *added]) + 1
    out = [b""] * size
    for token, i in model["model"]["vocab"].items():
        out[i] = bytes(byte[c] for c in token)
    for i, content in added.items():
        out[i] = content
    return out


def _decoder(path: str) -> Callable[[list], list[str]]:
    table = _kept(("pieces", path), lambda: pieces_of_bytes(path))
    return lambda rows: [b"".join(map(table.__getitem__, np.frombuffer(b or b"", "<u4").tolist())).decode("utf-8", "replace") for b in rows]


def _mapped(df: DataFrame, source: str, fn: Callable[[], Callable[[list], list[list]]], new: dict[str, tuple[pa.DataType, str]]) -> DataFrame:
    """``df`` with the columns ``new`` = fn()(source), a list of rows at a time; fn() runs in the worker."""
    kept = [c for c in df.columns if c not in new]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new], *[f"`{c}` {sql}" for c, (_, sql) in new.items()]])
    kinds = [kind for kind, _ in new.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = fn()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                values = map(pa.array, whole(part.column(source).to_pylist()), kinds)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *values], [*kept, *new])

    return df.mapInArrow(run, schema)


def _encoder(vocabulary: str, mean_bytes: int) -> Callable[[list], list[bytes]]:
    chunks = encoder(vocabulary, mean_bytes)
    return lambda texts: chunks.encode([(t or "").encode() for t in texts])


_IDS, _TEXT = (pa.binary(), "binary"), (pa.string(), "string")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", mean_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Adds ``ids``: the text's token ids as little-endian unsigned 32-bit numbers in one binary value.

    Equal to the library's encode(text, add_special_tokens=False). Null and empty texts have no ids (an empty value);
    repeated rows stay; an empty table gives an empty one; a column named ``ids`` is replaced, all others are kept.
    """

    def fn():
        to_ids = _encoder(vocabulary, mean_bytes)
        return lambda texts: [to_ids(texts)]

    return _mapped(docs, text, fn, {ids: _IDS})


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the library's decode(ids, skip_special_tokens=False) gives. Null ids decode to an empty text."""

    def fn():
        to_text = _decoder(vocabulary)
        return lambda rows: [to_text(rows)]

    return _mapped(encoded, ids, fn, {text: _TEXT})


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", mean_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``decode(encode(docs))`` in one pass: rows cross into Python once, and a task needs one worker with its tables, not two.

    Adds ``ids`` and ``decoded`` under the rules of the two; columns of these names are replaced.
    """

    def fn():
        to_ids, to_text = _encoder(vocabulary, mean_bytes), _decoder(vocabulary)

        def both(texts: list) -> list[list]:
            found = to_ids(texts)
            return [found, to_text(found)]

        return both

    return _mapped(docs, text, fn, {ids: _IDS, decoded: _TEXT})


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
