"""Token ids in binary files of fixed-width packed numbers.

A file holds the ids of one range of documents, each in the fewest bits that fit the vocabulary. Ids come in blocks of
BLOCK_IDS, so any position is found by one division and a block unpacks in a few numpy operations:

    blocks | block offsets, 64-bit | per document: id, id present, first position | footer

All numbers are little-endian. The footer has the places of the parts; readers start from it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.bpe import ENCODE_AT_ONCE, KEPT_UNITS, UNIT_BYTES, load
from scorewright.llm.common import staged, text_key

MAGIC = b"SWTOKEN1"
#: magic, bits per id, ids per block, ids, documents, place of the offsets, place of the document table
FOOTER = struct.Struct("<8sIIQQQQ")
BLOCK_IDS = 8192
#: Documents encoded at once.
ROWS_AT_ONCE = 2000
DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<u8")])
#: Documents a reader returns at once, at most; fewer when they are long.
READ_IDS = 1_000_000

MANIFEST = "shard int, path string, n_docs long, n_ids long"


def width(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Low bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):  # whole bytes need no shifts
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), axis=None, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for k in range(bits):
        out |= flat[:, k].astype(np.uint32) << np.uint32(k)
    return out


#: Marks that, behind letters, are a pre-token of their own; an apostrophe may belong to the letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def pre_tokens_of(word: str) -> int:
    """1 for letters, 2 for letters and marks behind; 0: not told by looking."""
    letters = word.rstrip(MARKS)
    return 1 + (len(letters) < len(word)) if letters.isalpha() else 0


class Words:
    """Ids of words, which tokenize independently under a vocabulary that drops white space.

    Each distinct word of a call is looked up once; ids are then gathered by position.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a pre-token; empty where the vocabulary does not tell.
        self.ends = np.zeros(0, bool)
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            if any(self.ends[e.ids].sum() != 2 for e in self.tokenizer.encode_batch_fast([f"a{m}" for m in [*MARKS, MARKS]], add_special_tokens=False)):
                self.ends = np.zeros(0, bool)  # marks are not always split off

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of letters as one text, which is cheaper. Each has as many pre-tokens as its characters show, or more; if
        the sum agrees, all agree."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        last = np.cumsum([pre_tokens_of(w) for w in words]) - 1
        if len(ends) != last[-1] + 1 or ends[-1] != len(ids) - 1:
            return self._one_by_one(words)
        cut = [0, *((ends[last] + 1) * 4).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _learn(self, distinct: list[str]) -> dict[str, bytes]:
        """Makes every word known; returns those that are too long to keep, or too many."""
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > KEPT_UNITS:
            # the words met first are the most frequent ones
            self.known = dict(islice(self.known.items(), KEPT_UNITS // 2))
            new = [w for w in distinct if w not in self.known]
        once: dict[str, bytes] = {}
        plain = [len(self.ends) > 0 and pre_tokens_of(w) > 0 for w in new]
        groups = [([w for w, p in zip(new, plain, strict=True) if p], self._together), ([w for w, p in zip(new, plain, strict=True) if not p], self._one_by_one)]
        for group, encode in groups:
            for i in range(0, len(group), ENCODE_AT_ONCE):
                part = group[i : i + ENCODE_AT_ONCE]
                for word, ids in zip(part, encode(part), strict=True):
                    (self.known if len(word) <= UNIT_BYTES and len(self.known) < KEPT_UNITS else once)[word] = ids
        return once

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        once = self._learn(distinct)
        known = self.known
        table = [known[w] if w in known else once[w] for w in distinct] if once else [known[w] for w in distinct]
        length = np.array(list(map(len, table)), np.int64) // 4
        first = np.cumsum(length) - length
        code = coded.indices.to_numpy()
        n = length[code]
        at = np.append(0, np.cumsum(n))
        flat = np.frombuffer(b"".join(table), "<u4")[np.repeat(first[code] - at[:-1], n) + np.arange(at[-1])]
        bounds = at[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    """The worker's known words; workers serve many tasks."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


class Writer:
    """One file; it appears under its name only when complete, so a repeated or second attempt does no harm."""

    def __init__(self, path: str, bits: int, block_ids: int = BLOCK_IDS):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.hidden = f"{self.path}.{uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.hidden)
        self.bits, self.block_ids = bits, block_ids
        self.waiting, self.n_waiting, self.n_ids, self.offsets, self.docs = [], 0, 0, [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.n_ids))
        self.waiting.append(ids)
        self.n_ids += len(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            block = pack(ids[i : min(i + self.block_ids, whole)], self.bits)
            self.out.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        offsets, docs = np.array(self.offsets, "<u8").tobytes(), np.array(self.docs, DOCS).tobytes()
        at = self.offsets[-1]
        self.out.write(offsets + docs + FOOTER.pack(MAGIC, self.bits, self.block_ids, self.n_ids, len(self.docs), at, at + len(offsets)))
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return len(self.docs), self.n_ids


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        self.fs, at = pafs.FileSystem.from_uri(path)
        self.file = self.fs.open_input_file(at)
        end = self.file.size()
        magic, self.bits, self.block_ids, self.n_ids, n_docs, offsets_at, docs_at = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        self.offsets = np.frombuffer(self.file.read_at(docs_at - offsets_at, offsets_at), "<u8")
        self.docs = np.frombuffer(self.file.read_at(n_docs * DOCS.itemsize, docs_at), DOCS)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file; reads only the blocks they lie in."""
        if n == 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        data = self.file.read_at(b - a, a)
        parts = []
        for k in range(first, last + 1):
            size = min(self.block_ids, self.n_ids - k * self.block_ids)
            parts.append(unpack(data[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a], size, self.bits))
        at = start - first * self.block_ids
        return np.concatenate(parts)[at : at + n]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order, null first, and writes one file per range of ids.

    Each document's ids are followed by ``end_id``. Returns the manifest (shard, path, n_docs, n_ids), written beside the
    files. Null and empty texts are the end id alone; rows with one doc_id lie in order of a hash of their text; an empty
    table writes no file. The vocabulary must drop white space between tokens; known words are then looked up.
    """
    bits = width(max(load(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        known = words(vocabulary)
        end = np.array([end_id], np.uint32)
        out = None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                ids = known.ids(part.column(1).to_pylist())
                for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                    if out is None:
                        path = f"{folder}/shard-{shard:06d}.ids"
                        out = Writer(path, bits, block_ids)
                    out.add(doc_id, np.concatenate([own, end]))
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    key = text_key(F.col("text")).alias("__key")
    ordered = docs.select("doc_id", "text", key).repartitionByRange("doc_id", "__key").sortWithinPartitions("doc_id", "__key")
    return staged(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "tokens")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``start`` counts the ids of all documents before, ``ids`` is
    binary, little-endian unsigned 32-bit numbers. Files are read block by block, one task a file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                yield from _documents(Reader(path), first)

    return files.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(file: Reader, first: int) -> Iterator[pa.RecordBatch]:
    starts = np.append(file.docs["start"], np.uint64(file.n_ids)).astype(np.int64)
    i = 0
    while i < len(file.docs):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + READ_IDS, "right")) - 1)
        data = file.ids(int(starts[i]), int(starts[j] - starts[i])).astype("<u4").tobytes()
        cut = (starts[i : j + 1] - starts[i]) * 4
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(file.docs["doc_id"][i:j].astype(np.int64), pa.int64(), mask=file.docs["known"][i:j] == 0),
                pa.array(first + starts[i:j], pa.int64()),
                pa.array(np.diff(starts[i : j + 1]), pa.int64()),
                pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
            ],
            ["doc_id", "start", "n_tokens", "ids"],
        )
        i = j

