"""Spelling variants of words by Bloom-guided neighbourhoods.

Words that differ by one inserted, deleted or replaced character are near. Each word generates its shorter neighbours (one
character deleted) and half of those of its length (one character replaced by a later one of the alphabet); the other half
and the longer ones are some other word's edits. Edits are probed, as numbers that an edit changes in one step, against
Bloom filters that hold the vocabulary's words by length, every word inside one cache line (a block). Only edits that a
filter lets pass become strings and are shuffled, to an exact join with the vocabulary that removes false positives.

The filters of all lengths lie one after another and are broadcast a bounded range of blocks at a time, whatever the
vocabulary's size: a larger one takes more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import dropped, staged

#: Letters of words; only A-Z are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A word is a variant of a near word that is at least so many times as frequent.
TIMES = 5
#: Bits of a filter per word, 64-bit numbers of a block, bits a word sets, and bytes of filters broadcast at a time.
WORD_BITS = 16
BLOCK_LONGS = 8
HASHES = 4
ROUND_BYTES = 16 * 2**20
#: Doublings that reach the end of any chain of forms: counts grow TIMES-fold along it and fit 63 bits.
DOUBLINGS = 5
WORDS_AT_ONCE = 2000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


# ---------------------------------------------------------------- vocabulary


def misspelt(word: Column, doc_id: Column, every: int = 199) -> Column:
    """The word without the character at crc32 modulo length where ``every`` divides the crc32 of "<doc_id>:<word>"; a null id reads as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = None) -> DataFrame:
    """(word, n): runs of LETTERS of at least MIN_LENGTH characters and their occurrences, MIN_COUNT at least.

    With ``every``, runs are first misspelt as above. Counts combine before the shuffle, so frequent words are no load.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = given.select("id", F.explode(F.split("t", f"[^{LETTERS}]+")).alias("word"))
    # shorter runs give no word, with or without a character less
    runs = runs.where(F.char_length("word") >= MIN_LENGTH).select("id", F.translate("word", upper, upper.lower()).alias("word"))
    word = F.col("word") if every is None else misspelt(F.col("word"), F.col("id"), every)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- numbers of words and their edits


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE, np.uint64), out=out[1:])
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    """Rows of code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _values(codes: np.ndarray) -> np.ndarray:
    """A polynomial of each row's code points, modulo 2**64."""
    return (codes * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class Filters:
    """Where each word length's filter lies among all blocks."""

    first: dict[int, int]
    blocks: dict[int, int]
    total: int

    def place(self, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each value, and the HASHES bits (0 to 64 * BLOCK_LONGS - 1) it sets there."""
        h = _mixed(values)
        block = self.first[length] + (h % np.uint64(self.blocks[length])).astype(np.int64)
        g = _mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        bits = np.stack([(g >> np.uint64(16 * k)) & np.uint64(64 * BLOCK_LONGS - 1) for k in range(HASHES)])
        return block, bits


def _sizes(words: DataFrame) -> Filters:
    """Filters sized by the counted words of each length; a row per length reaches the driver."""
    counts = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, blocks, at = {}, {}, 0
    for length in sorted(counts):
        blocks[length] = -(-counts[length] * WORD_BITS // (64 * BLOCK_LONGS))
        first[length] = at
        at += blocks[length]
    return Filters(first, blocks, at)


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _marks(words: DataFrame, filters: Filters) -> DataFrame:
    """(block, w0, w1, ...): the filters' blocks that are not empty."""
    names = [f"w{i}" for i in range(BLOCK_LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, group in _by_length(batch.column("word").to_pylist()).items():
                block, bits = filters.place(_values(_codes(group, length)), length)
                masks = np.zeros((len(group), BLOCK_LONGS), np.uint64)
                rows = np.arange(len(group))
                for b in bits:
                    masks[rows, (b >> np.uint64(6)).astype(int)] |= np.uint64(1) << (b & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(m) for m in masks.view(np.int64).T]], ["block", *names])

    marks = words.select("word").mapInArrow(run, ", ".join(["block long", *[f"{w} long" for w in names]]))
    return marks.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names])


def _round(marks: DataFrame, start: int, stop: int) -> np.ndarray:
    """Blocks start to stop - 1 of the filters, at most ROUND_BYTES of them."""
    table = marks.where((F.col("block") >= start) & (F.col("block") < stop)).toArrow()
    out = np.zeros((stop - start, BLOCK_LONGS), np.uint64)
    if table.num_rows:
        at = table.column("block").to_numpy() - start
        for i in range(BLOCK_LONGS):
            out[at, i] = table.column(f"w{i}").to_numpy().view(np.uint64)
    return out


# ---------------------------------------------------------------- edits


class _Probe:
    """Tests edits of a length against the broadcast range of blocks."""

    def __init__(self, filters: Filters, held: np.ndarray, start: int):
        self.filters, self.held, self.start = filters, held, start

    def __call__(self, values: np.ndarray, length: int) -> np.ndarray:
        """Positions of the values that may be words."""
        if length not in self.filters.blocks:
            return np.zeros(0, np.int64)
        block, bits = self.filters.place(values, length)
        block = block - self.start
        here = np.flatnonzero((block >= 0) & (block < len(self.held)))
        for b in bits:
            if not len(here):
                break
            here = here[(self.held[block[here], (b[here] >> np.uint64(6)).astype(int)] >> (b[here] & np.uint64(63))) & np.uint64(1) == 1]
        return here


def _deletions(codes: np.ndarray, probe: _Probe) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of deletions that may be words; of a run of equal characters the first stands for all."""
    n, length = codes.shape
    terms = codes * _powers(length)[:-1]
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
    # what stands behind moves one place to the front
    values = before + (whole - before - terms) * np.uint64(_INVERSE)
    wanted = np.ones(codes.shape, bool)
    wanted[:, 1:] = codes[:, 1:] != codes[:, :-1]
    flat = np.flatnonzero(wanted.ravel())
    hit = flat[probe(values.ravel()[flat], length - 1)]
    return hit // length, hit % length


def _replacements(codes: np.ndarray, alphabet: np.ndarray, probe: _Probe) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each position: (position, rows, characters) of replacements by a later character that may be words."""
    length = codes.shape[1]
    values, powers = _values(codes), _powers(length)
    for i in range(length):
        own = codes[:, i]
        row, c = np.nonzero(alphabet[None, :] > own[:, None])
        hit = probe(values[row] + (alphabet[c] - own[row]) * powers[i], length)
        yield i, row[hit], alphabet[c[hit]]


def _edits(words: DataFrame, alphabet: np.ndarray, probe_of) -> DataFrame:
    """(word, n, edit): edits that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = probe_of()
        for whole in batches:
            for s in range(0, whole.num_rows, WORDS_AT_ONCE):
                batch = whole.slice(s, WORDS_AT_ONCE)
                counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
                out: list[tuple[str, str]] = []
                for length, group in _by_length(list(counts)).items():
                    codes = _codes(group, length)
                    rows, at = _deletions(codes, probe)
                    out += [(w, w[:i] + w[i + 1 :]) for w, i in zip([group[r] for r in rows], at.tolist(), strict=True)]
                    for i, rows, put in _replacements(codes, alphabet, probe):
                        out += [(w, w[:i] + chr(c) + w[i + 1 :]) for w, c in zip([group[r] for r in rows], put.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in out], pa.string()), pa.array([counts[w] for w, _ in out], pa.int64()), pa.array([e for _, e in out], pa.string())], ["word", "n", "edit"]
                )

    return words.mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, other, other_n): all pairs of near words, both ways. ``words`` (word, n) is a staged table of distinct words."""
    spark = words.sparkSession
    filters = _sizes(words)
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct()
    # at most the letters of LETTERS
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)
    marks = staged(_marks(words, filters), "filters")
    step = max(1, round_bytes // (8 * BLOCK_LONGS))
    pairs = []
    for start in range(0, max(filters.total, 1), step):
        held = spark.sparkContext.broadcast(_round(marks, start, min(start + step, filters.total)))
        edits = _edits(words, alphabet, lambda held=held, start=start: _Probe(filters, held.value, start))
        known = words.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
        pairs.append(staged(edits.join(known, "edit").select("word", "n", F.col("edit").alias("other"), "other_n"), "near"))
        held.destroy()
    dropped(marks)
    once = pairs[0]
    for p in pairs[1:]:
        once = once.unionByName(p)
    return once.unionByName(once.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms, found by doubling its steps.

    After every round a step leads twice as far; the rounds end when no step leads to a word that has a step itself.
    """
    steps = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        done = staged(longer, "roots")
        dropped(steps)
        steps = done.select("word", "root")
        if done.where("moved").isEmpty():
            break
    return steps


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters, A-Z lower-cased, of at least 6 characters and 5 occurrences; ``every`` first misspells some
    (see ``misspelt``). The form is the near word of largest n, of equal ones the first in code-point order, if it is at
    least 5 times as frequent; root ends the chain of forms. Null and empty texts have no words; repeated rows and ids
    count as often as they stand; tables without words give no rows. Extra columns of any name are ignored.
    """
    words = staged(word_counts(docs, doc_id, text, every), "words")
    pairs = near_words(words, round_bytes)
    # counts and the first form combine before the shuffle; a word has few near words, whatever the vocabulary
    found = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("f"))
    is_form = -F.col("f.less") >= TIMES * F.col("n")
    found = staged(found.select("word", "n_near", F.when(is_form, F.col("f.form")).alias("form"), F.when(is_form, -F.col("f.less")).alias("form_n")), "forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
