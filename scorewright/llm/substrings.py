"""Removal of repeated word windows, found by recompression.

Rounds rewrite the texts' words: runs of one symbol become a symbol, then pairs of neighbours, left then right by a bit of
their hash, become one. A symbol's name depends on what it stands for alone, so it is the same in every document without
any dictionary, and a symbol depends on a few words around it only: inside equal passages the symbols are equal. Each
window takes one of its highest symbols (with the words that decide it) as its sign, chosen by the window's words alone.
Neighbouring windows mostly share their symbol, and such a stretch of windows is one row.

Spark then compares stretches: of equal ones (sign, and a hash of all their words) all but the first are removed as a
whole. What is left is one stretch of each kind; where several kinds share a sign, their windows are named one by one and
compared. A window that starts earlier lies in the first stretch of its kind, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import assign, dropped, small_side, staged, text_key

WINDOW = 20
ROUNDS = 2
#: Words of whole texts worked on at once; a longer text is worked on alone.
WORDS_AT_ONCE = 200_000
_END = np.iinfo(np.int32).max


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _grouped(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words that decide the symbols made of first[k]..first[k+1]-1: their parts' and both neighbours'.
    Past the text's ends there is no bound."""
    last = np.append(first[1:], len(low)) - 1
    before = np.where(first > 0, low[np.maximum(first - 1, 0)], -_END)
    after = np.where(last < len(low) - 1, high[np.minimum(last + 1, len(low) - 1)], _END)
    return before, after


class _Sums:
    """Hash of any stretch of words from running sums of word * MULTIPLIER ** place."""

    MULTIPLIER = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(self.MULTIPLIER, -1, 2**64), np.uint64)))
        forth = np.cumprod(np.append(np.uint64(1), np.full(n, self.MULTIPLIER, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(words * forth[:n]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = len(self.sums) - 1
        a, b = np.clip(low, 0, n), np.clip(high, 0, n)
        return (self.sums[b] - self.sums[a]) * self.back[a]


def recompress(words: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per round (signs, low, high) of its symbols: a window of words [p, q) with p <= low and high <= q holds all that
    decides the symbol, so every equal window has the same symbol at the same place. A sign names the symbol together
    with the words low to high."""
    n = len(words)
    symbols, low, high = words, np.arange(n), np.arange(1, n + 1)
    if n == 0:
        return []
    stretch = _Sums(words)
    levels = []
    for r in range(rounds):
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        length = np.diff(np.append(first, len(symbols))).astype(np.uint64)
        # a symbol that is no run depends on its neighbours too: they are other ones
        symbols = np.where(length > 1, _mix(symbols[first] ^ _mix(length, 1), 2), symbols[first])
        low, high = _grouped(low, high, first)
        right = (_mix(symbols, 10 + r) >> np.uint64(63)).astype(bool)
        joined = np.append(False, ~right[:-1] & right[1:])  # with the symbol before
        first = np.flatnonzero(~joined)
        paired = np.append(joined[1:], False)[first]
        following = symbols[np.minimum(first + 1, len(symbols) - 1)]
        symbols = np.where(paired, _mix(_mix(symbols[first], 6) ^ following, 7), symbols[first])
        low, high = _grouped(low, high, first)
        levels.append((_mix(symbols ^ _mix(stretch(low, high), 5), 4), low, high))
    return levels


def signs_of_windows(words: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Per window its sign and where it stands, -1 for windows without one: the smallest hash among the highest round's
    symbols that the window holds whole."""
    n = len(words) - window + 1
    sign, place = np.zeros(max(n, 0), np.uint64), np.full(max(n, 0), -1)
    if n <= 0:
        return sign, place
    at = np.arange(n)
    for level, (signs, low, high) in reversed(list(enumerate(recompress(words, rounds)))):
        # low and high ascend, so a window holds a stretch of symbols
        a, b = np.searchsorted(low, at, "left"), np.searchsorted(high, at + window, "right")
        found = (b > a) & (place < 0)
        if not found.any():
            continue
        rank = _mix(signs, 8)
        table, k = [np.arange(len(signs))], 1
        while 2 * k <= int((b - a).max()):
            x, y = table[-1][:-k], table[-1][k:]
            table.append(np.where(rank[x] <= rank[y], x, y))
            k *= 2
        power = np.floor(np.log2(np.maximum(b - a, 1))).astype(int)
        for e in range(len(table)):
            here = found & (power == e)
            x, y = table[e][a[here]], table[e][b[here] - 2**e]
            chosen = np.where(rank[x] <= rank[y], x, y)
            sign[here] = signs[chosen]
            place[here] = chosen * rounds + level
    return sign, place


def window_names(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64- and 32-bit names of each window's words, in order."""
    n = len(words) - window + 1
    return _names(words, np.arange(max(n, 0)), np.arange(max(n, 0)) + window)


def _names(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the words low to high - 1, of any number."""
    length = _mix((high - low).astype(np.uint64), 14)
    return _mix(_Sums(words)(low, high) ^ length, 12), (_mix(_Sums(_mix(words, 11))(low, high) ^ length, 13) >> np.uint64(32)).astype(np.uint32)


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in one array, each text closed by a hash of its own, and where the texts start.

    No window that holds such a closing hash counts, and symbols that depend on one lie in no other window, so a text's
    signs are those it has alone.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(int(sizes.sum()) + len(texts), np.uint64)
    ends = np.zeros(len(out), bool)
    ends[first + sizes] = True
    out[ends] = _mix(np.arange(len(texts), dtype=np.uint64), 15)
    out[~ends] = word_hashes([w for t in texts for w in t])
    return out, first


def _in_parts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list[dict], list[list[bytes]]]]:
    """Rows whose text has a window, with its words, about WORDS_AT_ONCE words at a time."""
    rows: list[dict] = []
    texts: list[list[bytes]] = []
    n = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            for row in batch.slice(i, 500).to_pylist():
                words = (row.pop("text") or "").encode().split()
                if len(words) < window:
                    continue
                rows.append(row)
                texts.append(words)
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    yield rows, texts
                    rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def stretches(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, start, length, sign, name, check) of the stretches of windows of one sign in texts joined as above.

    Windows without a symbol inside are stretches of their own, their name is their sign.
    """
    sign, place = signs_of_windows(words, window)
    n = len(sign)
    at = np.arange(n)
    text = np.searchsorted(first, at, "right") - 1
    inside = at + window < np.append(first[1:], len(words))[text]
    bare = place < 0
    place = np.where(bare, -2 - at, place)
    start = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1]))[:n])
    length = np.diff(np.append(start, n))
    start, length = start[inside[start]], length[inside[start]]
    name, check = _names(words, start, start + length + window - 1)
    own = np.where(bare[start], name, sign[start])
    return text[start], start - first[text[start]], length, own, name, check


STRETCH = "doc_id long, key long, start int, length int, sign long, name long, check int"


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _in_parts(batches, window):
            text, start, length, sign, name, check = stretches(*_joined(texts), window)
            ids, keys = (np.array([r[c] for r in rows], np.int64)[text] for c in ("doc_id", "key"))
            columns = [ids, keys, start.astype(np.int32), length.astype(np.int32), sign.view(np.int64), name.view(np.int64), check.view(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in STRETCH.split(", ")])

    return docs.select("doc_id", "key", "text").mapInArrow(run, STRETCH)


def _named(docs: DataFrame, window: int) -> DataFrame:
    """(name, check, doc_id, key, at) of the windows in ``spans`` of each row of ``docs`` (doc_id, key, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _in_parts(batches, window):
            words, first = _joined(texts)
            spans = [(i, s["start"], s["length"]) for i, r in enumerate(rows) for s in r["spans"]]
            text, start, length = (np.array(x, np.int64) for x in zip(*spans, strict=True))
            row = np.repeat(text, length)
            at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
            name, check = _names(words, first[row] + at, first[row] + at + window)
            ids, keys = (np.array([r[c] for r in rows], np.int64)[row] for c in ("doc_id", "key"))
            columns = [name.view(np.int64), check.view(np.int32), ids, keys, at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "check", "doc_id", "key", "at"])

    return docs.select("doc_id", "key", "text", "spans").mapInArrow(run, "name long, check int, doc_id long, key long, at int")


def _rewritten(docs: DataFrame, window: int, schema: str, kept: list[str]) -> DataFrame:
    """Drops the words covered by the stretches of windows in ``gone``; all of them where ``copy`` holds and a window fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                n_words, n_removed, texts = [], [], []
                for text, gone, copy in zip(*(part.column(c).to_pylist() for c in ("__text", "__gone", "__copy")), strict=True):
                    words = (text or "").encode().split()
                    n = len(words)
                    n_words.append(n)
                    if copy and n >= window:
                        words = []
                    elif gone:
                        edge = np.zeros(n + 1, np.int64)
                        for g in gone:
                            edge[g["start"]] += 1
                            edge[g["start"] + g["length"] + window - 1] -= 1
                        words = [w for w, c in zip(words, np.cumsum(edge)[:n].tolist(), strict=True) if c == 0]
                    n_removed.append(n - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                    [*kept, "n_words", "n_removed", "kept_text"],
                )

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n_words, n_removed, kept_text`` behind its columns.

    A word goes if a window of ``window`` words over it has the same words as one that starts earlier: in a document of
    smaller doc_id, or before in the same one. Windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words. Rows equal in id and text are one document and are treated alike; null ids come
    last; among different texts with one id the order is a hash of the text. An empty table gives an empty one; columns
    named like the new ones are replaced.
    """
    late = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    other_key = F.xxhash64(F.lit(7), F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(F.col("doc_id"), "text").withColumns({"order": late, "key": text_key(F.col("text")), "key2": other_key})
    # texts, told by 128 bits, that occur under several ids: all but the first are copies as a whole
    several = staged(
        base.groupBy("key", "key2").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first < last").select("key", "key2", "first"), "substrings"
    )
    several_side = small_side(several)
    originals = base.join(several_side, ["key", "key2"], "left").where(F.col("first").isNull() | (F.col("order") == F.col("first")))
    originals = originals.select("key", F.col("order").alias("doc_id"), "text")

    spans = staged(_stretches(originals, window), "substrings")
    # counts combine before the shuffle: one row per task and sign, so a passage in every document is no burden
    counted = spans.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sign")
    found = staged(spans.join(counted, "sign", "left_semi"), "substrings")
    dropped(spans)
    kind = ["sign", "name", "check"]
    kinds = staged(found.groupBy(*kind).agg(F.min(F.struct("doc_id", "key", "start", "length")).alias("first"), F.count(F.lit(1)).alias("n")), "substrings")
    again = found.join(kinds.where("n > 1").select(*kind, "first"), kind)
    again = again.where(F.struct("doc_id", "key", "start") > F.struct("first.doc_id", "first.key", "first.start")).select("doc_id", "key", "start", "length")
    again = staged(again, "substrings")
    dropped(found)

    # only kinds that share their sign with others can hold windows of others
    shared = kinds.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sign")
    live = kinds.join(shared, "sign", "left_semi").select("first.*")
    live = staged(live.groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("spans")), "substrings")
    dropped(kinds)
    windows = staged(_named(originals.join(live, "key"), window), "substrings")
    dropped(live)
    place = F.struct("doc_id", "key", "at")
    firsts = windows.groupBy("name", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "check", "first")
    later = windows.join(firsts, ["name", "check"]).where(place > F.col("first")).select("doc_id", "key", F.col("at").alias("start"), F.lit(1).alias("length"))
    gone = staged(again.unionByName(later).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length")).alias("__gone")), "substrings")
    dropped(windows, again)

    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept], "n_words long, n_removed long, kept_text string"])
    rows = assign(docs.select(*[F.col(f"`{c}`") for c in kept]), __text=F.col("text"), __order=late, __key=text_key(F.col("text")), __key2=other_key)
    rows = rows.join(gone.select(F.col("doc_id").alias("__order"), F.col("key").alias("__key"), "__gone"), ["__order", "__key"], "left")
    rows = rows.join(several_side.select(F.col("key").alias("__key"), F.col("key2").alias("__key2"), F.col("first").alias("__first")), ["__key", "__key2"], "left")
    rows = rows.select(*kept, "__text", "__gone", (F.col("__order") > F.col("__first")).alias("__copy"))
    return _rewritten(rows, window, schema, kept)
