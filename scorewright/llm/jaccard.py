"""Near-duplicate texts by a Jaccard join on word shingles, with whole parts of the sets as signatures.

If a set's tokens are dealt into parts by their hash, every token that two sets do not share changes one part. Similar sets
differ in few tokens, so with one part more than these one at least is the same in both. Parts hold several tokens, so
other sets seldom have one in common, however large the corpus; those that do are compared whole. Signatures, far more than
documents, are shuffled packed; those that one set has alone never become rows.

Equal sets are one node. Lists of nodes under one part are not expanded into pairs at once: nodes are first
linked through a few representatives, and pairs are formed only where a list still holds different components; a pair's
rows, one from each list, are its count of equal parts. Long lists
that share nodes are then one, and compared block by block of sets, so that only links become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import dropped, small_side, staged, text_key, worker_tables
from scorewright.llm.components import components

SIMILARITY = (9, 10)
SHINGLE_WORDS = 3
#: Ratio of the largest sizes of neighbouring schemes of parts.
SIZE_STEP = 1.4
#: Cells of the ranks that an order of tokens puts first to last, as a power of 2.
SKETCH_BITS = 18
#: Representatives a list links through in each round after the first, which has one.
REPRESENTATIVES = 4
#: Pairs may be formed once they are at most so many times the entries of the lists.
PAIRS_PER_ENTRY = 16
MAX_ROUNDS = 6
#: Lists of more nodes are compared in blocks of sets, not as pairs.
LONG_LIST = 32
#: Sending a set to a group counts as much as comparing so many pairs (an estimate, not measured).
PAIRS_PER_ROW = 256
#: Sets and tokens of a block, about.
BLOCK_SETS = 2048
BLOCK_TOKENS = 1 << 18
#: The lowest bits of a part's hash hold its scheme.
SCHEME_BITS = 7
#: Signatures that a worker packs at a time, that a row holds, and that a bucket gets, about.
PACKED, PACKED_ROW, BUCKET = 1 << 19, 1 << 10, 1 << 19
#: Bits of hashes and names that are sent beyond those that number them; one in 2^SPARE_BITS then meets a stranger.
SPARE_BITS, MOST_BITS = 10, 44

_LARGEST = 2**40
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes.maketrans(_UPPER, bytes(range(0x61, 0x7B)))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * _MIX
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending: A-Z lower-cased, ``words`` words each; a shorter text
    is one shingle, a text without words none."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    h = np.full(n, np.uint64(words))
    for k in range(words):
        h = mixed(h ^ one[k : n + k], k + 1)
    return np.unique(h)


def prefix_length(n: int, similarity: tuple[int, int], shared: int = 1) -> int:
    """Tokens of a set of n among which a similar set must share ``shared``, or all its least overlap if that is smaller."""
    overlap = -(-n * similarity[0] // similarity[1])
    return n - overlap + min(shared, overlap)


def _prefix(s: np.ndarray, ranks: np.ndarray, order: int, similarity: tuple[int, int], shared: int = 1) -> np.ndarray:
    """The tokens of ``s`` that come first under the order, as signed numbers."""
    k = prefix_length(len(s), similarity, shared) if len(s) else 0
    if k < len(s):
        of = ranks[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        s = s[np.argpartition(of | (mixed(s, 100 + order) >> np.uint64(8)), k - 1)[:k]]
    return s.view(np.int64)


@cache
def _schemes(similarity: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(largest size, parts, kept back, least tokens) of every scheme; the first has no parts: there only equal sets are similar.

    A pair uses the scheme of its larger set. Of parts = most differences + kept back, at least ``kept back`` are equal in
    both sets. Parts of fewer than ``least tokens`` say little; about as many as are expected are kept back for them.
    """
    num, den = similarity
    if num >= den:
        return [(_LARGEST, 0, 0, 0)]
    top = -(-(den + num) // (2 * (den - num))) - 1
    out = [(top, 0, 0, 0)]
    while top < _LARGEST:
        smallest, top = max(1, (top + 1) * num // den), int(top * SIZE_STEP) + 1
        most = 2 * top * (den - num) // (den + num)
        least = 2 if smallest >= 5 * (most + 1) else 1
        back = 1
        for _ in range(50):
            mean = smallest / (most + back)
            small = (most + back) * exp(-mean) * (1 + mean * (least > 1))
            back = max(back, 1 + ceil(small + 2 * sqrt(small)))
            if back > most + 1:
                back = most + 1
                break
        out.append((top, most + back, back, least))
    return out


def signatures(s: np.ndarray, similarity: tuple[int, int]) -> tuple[int, list[np.ndarray]]:
    """The first scheme of a set, and hashes of its parts by scheme; two different sets of this similarity have one hash in common at least.

    A scheme deals all tokens into parts by their hash. A set takes the scheme of its own size, and the next ones if a
    similar set may be of their sizes. Small parts are left out if there are fewer of them than equal parts of similar sets.
    Of the least number of hashes that one of two similar sets has, at most as many as they differ in tokens are missing
    in the other: an equal part is small in both. The lowest bits of a hash are its scheme.
    """
    first, out = 0, []
    for i, at, sizes, kept in _dealt(s, similarity):
        sums = np.zeros(len(sizes), np.uint64)
        filled = np.flatnonzero(sizes)
        sums[filled] = np.add.reduceat(mixed(s, 300)[np.argsort(at)], (np.cumsum(sizes) - sizes)[filled])
        names = mixed(sums ^ mixed(np.arange(len(sizes), dtype=np.uint64), 1000 + i), 301)
        names = names >> np.uint64(SCHEME_BITS) << np.uint64(SCHEME_BITS) | np.uint64(i)
        first = first or i
        out.append(names[kept].view(np.int64))
    return first, out


def _dealt(s: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(scheme, part of each token, sizes of the parts, which parts' hashes are kept) for every scheme of a set."""
    schemes, n = _schemes(similarity), len(s)
    reach = n * similarity[1] // similarity[0]
    for i, (top, parts, back, least) in enumerate(schemes):
        if not parts or top < n:
            continue
        if schemes[i - 1][0] >= max(n, reach):
            break
        at = (mixed(s, 200 + i) % np.uint64(parts)).astype(np.int64)
        sizes = np.bincount(at, minlength=parts)
        small = sizes < least
        yield i, at, sizes, ~small if small.sum() < back else np.ones(parts, bool)


def packed(parts: np.ndarray, names: np.ndarray, buckets: int, bits: int, name_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes): the first ``bits`` bits and the scheme of the parts' hashes, and the first bytes of the names.

    Equal hashes are of one bucket. Hashes ascend in a row and are sent as differences, byte by byte of all, so that the
    high bytes, nearly all zero, shrink in the shuffle.
    """
    scheme = np.uint64((1 << SCHEME_BITS) - 1)
    parts = parts >> np.uint64(64 - bits) << np.uint64(SCHEME_BITS) | parts & scheme
    order = np.argsort(parts)
    parts, names = parts[order], names[order] >> np.uint64(64 - 8 * name_bytes)
    of = ((parts >> np.uint64(SCHEME_BITS)) * np.uint64(buckets) >> np.uint64(bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    starts = np.concatenate([np.arange(a, z, PACKED_ROW) for a, z in zip(starts, np.r_[starts[1:], len(of)], strict=True)])
    steps = np.diff(parts, prepend=np.uint64(0))
    steps[starts] = parts[starts]
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n] for x, n in ((steps, _part_bytes(bits)), (names, name_bytes))]
    for a, z in zip(starts, np.r_[starts[1:], len(of)], strict=True):
        yield int(of[a]), b"".join(x[:, a:z].tobytes() for x in planes)


def unpacked(row: bytes, bits: int, name_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortened hashes and names of a row of ``packed``."""
    planes = np.frombuffer(row, np.uint8).reshape(_part_bytes(bits) + name_bytes, -1)
    sides = planes[: _part_bytes(bits)], planes[_part_bytes(bits) :]
    steps, names = (sum(x.astype(np.uint64) << np.uint64(8 * i) for i, x in enumerate(side)) for side in sides)
    return np.cumsum(steps, dtype=np.uint64), names


def _part_bytes(bits: int) -> int:
    return -(-(bits + SCHEME_BITS) // 8)


def _name(s: np.ndarray) -> int:
    """64-bit name of a set, signed."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _described(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, key, n, node, of): set size, a 64-bit name of the set, and how many signatures it has in each of its schemes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("jaccard")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.int64()),
                        pa.array([[int(kept.sum()) for *_, kept in _dealt(s, similarity)] for s in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "key", "n", "node", "of"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, node long, of array<int>")


def _signed(docs: DataFrame, described: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(part, node, n, of): shortened signatures that more than one node has; ``of`` is how many the node has in the part's
    scheme. Names are shortened too, so few nodes may be among them that do not have the part; none is missing.

    Nearly all signatures are of one node alone. They are shuffled packed, some 8 bytes each, and only the others become rows.
    """
    spark = docs.sparkSession
    n_nodes, n_signatures = nodes.agg(F.count(F.lit(1)), F.sum(F.aggregate("of", F.lit(0).cast("long"), lambda x, y: x + y))).first()
    bits = min(MOST_BITS, int(n_signatures or 0).bit_length() + SPARE_BITS)
    name_bytes = min(8, -(-(n_nodes.bit_length() + SPARE_BITS) // 8))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_signatures or 0) // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("jaccard")
        held: list[tuple[int, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            parts = np.concatenate([x for _, x in held]).view(np.uint64)
            names = np.repeat(np.array([x for x, _ in held], np.int64).view(np.uint64), [len(x) for _, x in held])
            held.clear()
            rows = list(packed(parts, names, buckets, bits, name_bytes)) if len(parts) else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "packed"])

        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for text in batch.column("text").slice(i, 500).to_pylist():
                    s = shingles(text, words)
                    signed = signatures(s, similarity)[1]
                    held.extend((_name(s), x) for x in signed)
                    n += sum(len(x) for x in signed)
                    if n >= PACKED:
                        yield sent()
                        n = 0
        if held:
            yield sent()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("jaccard")
        bucket, held = None, []

        def repeated() -> pa.RecordBatch:
            parts, names = (np.concatenate(x) for x in zip(*[unpacked(x, bits, name_bytes) for x in held], strict=True))
            held.clear()
            order = np.argsort(parts)
            parts, names = parts[order], names[order]
            same = parts[1:] == parts[:-1]
            kept = np.r_[False, same] | np.r_[same, False]
            return pa.RecordBatch.from_arrays([pa.array(parts[kept].view(np.int64)), pa.array(names[kept].view(np.int64))], ["part", "name"])

        for batch in batches:
            for at, row in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if at != bucket and held:
                    yield repeated()
                bucket = at
                held.append(row)
        if held:
            yield repeated()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", text_key(F.col("text")).alias("key"))
    same = (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))
    named = lambda x: x.select(F.col("key").alias("key_"), F.col("id").alias("id_"))
    # only copies are looked up and left out; texts that repeat under one id are shuffled to be merged
    texts = described.where("n > 0").select("key", F.col("doc_id").alias("id")).distinct()
    skipped = small_side(staged(texts.join(named(nodes.where("rows = 1")), same, "left_anti"), "jaccard"))
    once = rows.join(named(skipped), same, "left_anti")
    several = nodes.where("rows > 1")
    if not several.isEmpty():
        once = once.unionByName(rows.join(small_side(named(several)), same, "left_semi").dropDuplicates(["key", "id"]))
    dealt = once.select("text").mapInArrow(run, "bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    found = staged(dealt.mapInArrow(met, "part long, name long"), "jaccard", texts=True)
    named = nodes.select("node", "n", "scheme", F.col("of").alias("each"), F.shiftrightunsigned("node", 64 - 8 * name_bytes).alias("name"))
    rows = found.join(named, "name").select("part", "node", "n", F.get("each", _scheme() - F.col("scheme")).cast("long").alias("of"))
    # a node stands in a part once, also if another one's name begins as its own
    return rows.repartition("part").dropDuplicates(["part", "node"])


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, tokens) of the wanted (key, id), from the texts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("jaccard")
        seen: set[tuple[int, int | None]] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = []
                for at, *row in zip(range(part.num_rows), part.column("key").to_pylist(), part.column("id").to_pylist(), strict=True):
                    if tuple(row) not in seen:
                        seen.add(tuple(row))
                        sets.append(shingles(part.column("text")[at].as_py(), words))
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", text_key(F.col("text")).alias("key"))
    n = wanted.count()
    chosen = small_side(wanted.select(F.col("key").alias("key_"), F.col("id").alias("id_")), n)
    # one document of each set, so copies of a text are never shuffled
    rows = rows.join(chosen, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    sets = staged(rows.select("text", "key", "id").mapInArrow(run, "node long, tokens array<long>"), "jaccard", texts=True)
    if sets.count() == n:
        return sets
    # rows equal in id and text that different tasks have read
    once = staged(sets.dropDuplicates(["node"]), "jaccard")
    dropped(sets)
    return once


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str], n_pairs: int) -> DataFrame:
    """Pairs (a, b) with the columns of both nodes. Rows travel to their pairs once: those of ``a``, and of ``b``, which has many ``a``."""
    side = lambda x: rows.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    heads = side("b").join(small_side(pairs.select("b"), n_pairs), "b", "left_semi")
    return side("a").join(small_side(pairs.select("a", "b"), n_pairs), "a").join(heads, "b")


def _scheme() -> Column:
    """The scheme of a list."""
    return F.col("part").bitwiseAND((1 << SCHEME_BITS) - 1).cast("int")


def _tops(similarity: tuple[int, int]) -> Column:
    """The largest sizes of all schemes."""
    return F.array(*[F.lit(top) for top, *_ in _schemes(similarity)]).cast("array<long>")


def _fit(n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    """Sets of these sizes may be similar, and their list is in the scheme of the larger one."""
    num, den = similarity
    least, most, tops = F.least(n, m), F.greatest(n, m), _tops(similarity)
    own = (F.get(tops, _scheme()) >= most) & ((_scheme() == 1) | (F.get(tops, _scheme() - 1) < most))
    return (least * den >= most * num) & own


def _least_equal(n: Column, m: Column, of: Column, of_m: Column, similarity: tuple[int, int]) -> Column:
    """Parts that similar sets of n and m tokens, of so many signatures in the scheme, have in common at least."""
    num, den = similarity
    return F.greatest(F.least(of, of_m) - F.floor((n + m) * (den - num) / (den + num)), F.lit(1).cast("long"))


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: tuple[int, int], n_pairs: int) -> DataFrame:
    """Pairs whose sizes and equal parts allow the similarity, with both texts' key and id."""
    num, den = similarity
    both = _both(pairs, nodes, ["n", "scheme", "parts", "of", "key", "id"], n_pairs).where(F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
    # in the scheme of the larger set; both have it, but no part there is in any list if they have none in common
    scheme = F.greatest("a_scheme", "b_scheme")
    parts = lambda x: F.filter(f"{x}_parts", lambda p: p.bitwiseAND((1 << SCHEME_BITS) - 1) == scheme)
    of = lambda x: F.get(F.col(f"{x}_of"), scheme - F.col(f"{x}_scheme"))
    equal = F.size(F.array_intersect(parts("a"), parts("b")))
    return both.where(equal >= _least_equal(F.col("a_n"), F.col("b_n"), of("a"), of("b"), similarity)).select("a", "b", "a_key", "a_id", "b_key", "b_id")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], n_pairs: int) -> DataFrame:
    """Pairs whose whole sets are similar."""
    both = _both(pairs, sets, ["tokens"], n_pairs)
    inter = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - inter
    return both.where(inter * similarity[1] >= union * similarity[0]).select("a", "b")


def _common(rows: list[np.ndarray], tokens: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Numbers of common tokens of every left and right set, from the (row, token) of either side."""
    out = np.zeros(shape, np.int64)
    n = 1 + max((int(t.max()) for t in tokens if len(t)), default=-1)
    of = [np.bincount(t, minlength=n) for t in tokens]
    product = of[0] * of[1]
    # tokens of few pairs are counted pair by pair, the others by matrix products
    few = (product > 0) & (product <= 256)
    order = np.argsort(tokens[1], kind="stable")
    start = np.cumsum(of[1]) - of[1]
    at = few[tokens[0]]
    left, t = rows[0][at], tokens[0][at]
    times = of[1][t]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    right = rows[1][order[np.repeat(start[t], times) + within]]
    out += np.bincount(np.repeat(left, times) * shape[1] + right, minlength=shape[0] * shape[1]).reshape(shape)
    many = np.flatnonzero(product > 256)
    column = np.full(n, -1)
    for i in range(0, len(many), 2048):
        column[:] = -1
        column[many[i : i + 2048]] = np.arange(len(many[i : i + 2048]))
        sides = []
        for r, t, size in zip(rows, tokens, shape, strict=True):
            side = np.zeros((size, len(many[i : i + 2048])), np.float32)
            at = column[t] >= 0
            side[r[at], column[t[at]]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _spanning(edges: np.ndarray) -> list[int]:
    """Places of edges that connect all that the edges connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for i, (a, b) in enumerate(edges.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(i)
    return kept


def _bundled(lists: DataFrame) -> DataFrame:
    """The lists (part, node, component, main) with those of one scheme that share nodes made one, in which each node stands once.

    All pairs of the lists are pairs of their bundle. Lists whose bundle costs more than they cost together, in pairs and
    in rows, stay as they are: long chains of lists, for example.
    """
    scheme = F.col("part").bitwiseAND((1 << SCHEME_BITS) - 1).alias("scheme")
    least = F.min("part").over(Window.partitionBy("node", scheme))
    linked = small_side(staged(components(lists.select(F.col("part").alias("a"), least.alias("b"))), "jaccard").select(F.col("node").alias("part"), F.col("component").alias("bundle")))
    bundle = F.coalesce("bundle", "part").alias("bundle")
    members = lists.groupBy("node", "component", scheme).agg(F.min("part").alias("part")).join(linked, "part", "left")
    members = staged(members.select(bundle, "node", "component"), "jaccard")
    cost = lambda few, every: few.cast("double") * every + PAIRS_PER_ROW * (few + every)
    outside = F.sum((F.col("component") != F.col("main")).cast("long"))
    alone = staged(lists.groupBy("part").agg(cost(outside, F.count(F.lit(1))).alias("cost")).join(linked, "part", "left").select("part", "cost", bundle), "jaccard")
    parts = members.groupBy("bundle", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("bundle").agg(F.max(F.struct("c", "component")).alias("largest"), F.sum("c").alias("all"))
    one = largest.join(alone.groupBy("bundle").agg(F.sum("cost").alias("cost")), "bundle")
    one = one.where(cost(F.col("all") - F.col("largest.c"), F.col("all")) <= F.col("cost"))
    one = small_side(staged(one.select("bundle", F.col("largest.component").alias("main")), "jaccard"))
    together = members.join(one, "bundle").select(F.col("bundle").alias("part"), "node", "component", "main")
    done = small_side(staged(alone.join(one, "bundle", "left_semi").select("part"), "jaccard"))
    return staged(lists.select(together.columns).join(done, "part", "left_anti").unionByName(together), "jaccard")


def _in_blocks(lists: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links between different components in each list (part, node, component, main): blocks of the sets outside the list's
    largest component meet blocks of all its sets, each two in one group; links that close a circle there are left out."""
    sized = lists.join(small_side(sets.select("node", F.size("tokens").alias("n"))), "node")
    blocks = lambda which: F.greatest(
        F.ceil(F.sum(F.when(which, F.col("n"))) / BLOCK_TOKENS), F.ceil(F.count(F.when(which, F.lit(1))) / BLOCK_SETS)
    ).cast("int")
    outside = F.col("component") != F.col("main")
    rows = lists.join(sized.groupBy("part").agg(blocks(outside).alias("few"), blocks(F.lit(True)).alias("all")), "part")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(outside).select("part", block("few").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "node", "component")
    right = rows.select("part", every("few").alias("i"), block("all").alias("j"), F.lit(1).alias("side"), "node", "component")
    met = staged(left.unionByName(right), "jaccard")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sides, names, found = table["side"].to_numpy(), table["node"].to_numpy(), table["component"].to_numpy()
        arrays = table["tokens"].combine_chunks()
        n = np.diff(arrays.offsets.to_numpy())
        token = np.unique(arrays.flatten().to_numpy(), return_inverse=True)[1]
        place = np.where(sides == 0, np.cumsum(sides == 0), np.cumsum(sides == 1)) - 1
        row, side = np.repeat(place, n), np.repeat(sides, n)
        at = [np.flatnonzero(sides == x) for x in (0, 1)]
        inter = _common([row[side == x] for x in (0, 1)], [token[side == x] for x in (0, 1)], (len(at[0]), len(at[1])))
        union = n[at[0]][:, None] + n[at[1]][None, :] - inter
        a, b = np.nonzero((inter * similarity[1] >= union * similarity[0]) & (found[at[0]][:, None] != found[at[1]][None, :]))
        a, b = at[0][a], at[1][b]
        kept = _spanning(np.stack([found[a], found[b]], axis=1))
        return pa.table({"a": pa.array(names[a[kept]], pa.int64()), "b": pa.array(names[b[kept]], pa.int64())})

    return met.join(sets, "node").groupBy("part", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, words: int = SHINGLE_WORDS,
    representatives: int = REPRESENTATIVES, pairs_per_entry: float = PAIRS_PER_ENTRY,
) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, group), one row per row of ``docs`` (doc_id, text).

    Two documents link if |A & B| * similarity[1] >= |A | B| * similarity[0]; component_id is the smallest doc_id reachable
    by links, the document itself included. Documents without words link with nothing; a null id never is a component's
    id (the component of a row without id and without partner is null); rows that repeat stay. ``key`` hashes the text, ``group``
    names the component, null for documents without words.
    An empty table gives an empty one. ``similarity`` is a fraction of whole numbers, so the comparison is exact.
    """
    named = staged(_described(docs, words, similarity), "jaccard", texts=True)
    copies = named.where("n > 0").groupBy("node", "key", F.col("doc_id").alias("id"), "n", "of").agg(F.count(F.lit(1)).alias("rows"))
    nodes = copies.groupBy("node", "n", "of").agg(F.min(F.struct("key", "id", "rows")).alias("at")).select("node", "at.*", "n", "of")
    scheme = F.greatest(F.size(F.filter(_tops(similarity), lambda top: top < F.col("n"))), F.lit(1))
    nodes = staged(nodes.withColumn("scheme", scheme), "jaccard")
    # only lists with two nodes or more are kept, each entry with the list's smallest node
    of = Window.partitionBy("part")
    entries = _signed(docs, named, nodes, words, similarity).withColumn("head", F.min(F.struct("node", "n")).over(of)).withColumn("m", F.count(F.lit(1)).over(of))
    lists = staged(entries.where("m > 1").select("part", "node", "n", "of", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"), "m"), "jaccard")
    # parts that are in no list are in no other set, so pairs are judged by those in lists
    listed = lists.groupBy("node").agg(F.collect_list("part").alias("parts"))
    members = staged(nodes.join(listed, "node").select("node", "key", "id", "n", "scheme", "parts", "of"), "jaccard")
    dropped(nodes)
    labels = _labels(docs, words, lists, members, similarity, representatives, pairs_per_entry)
    dropped(members)

    if labels is not None:
        named = named.join(small_side(labels), "node", "left").withColumn("group", F.coalesce("component", "node"))
    else:
        named = named.withColumn("group", F.col("node"))
    least = named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    return named.join(least, "group", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("group")).alias("group"),
    )


def _labels(
    docs: DataFrame, words: int, lists: DataFrame, nodes: DataFrame, similarity: tuple[int, int], representatives: int, pairs_per_entry: float
) -> DataFrame | None:
    """(node, component) by verified links, whose components are those of all links; None without candidates."""
    n_entries, left = lists.agg(F.count(F.lit(1)), F.sum(F.col("m") - 1) / 2).first()
    if n_entries == 0:
        return None

    def joined(pairs: DataFrame, labels: DataFrame | None, long: DataFrame | None = None, judged: bool = False) -> DataFrame:
        """Components after the similar ones of the pairs, and of those in the long lists, are linked. ``judged``: the pairs
        are distinct, and their sizes and equal parts allow the similarity."""
        pairs = staged(pairs if judged else pairs.distinct(), "jaccard")
        n = pairs.count()
        possible = staged(_both(pairs, nodes, ["key", "id"], n) if judged else _possible(pairs, nodes, similarity, n), "jaccard")
        dropped(pairs)
        ends = possible.select(F.inline(F.array(*[F.struct(F.col(f"{x}_key").alias("key"), F.col(f"{x}_id").alias("id")) for x in "ab"])))
        if long is not None:
            members = small_side(staged(long.select("node").distinct(), "jaccard"))
            ends = ends.unionByName(nodes.join(members, "node", "left_semi").select("key", "id"))
        sets = _sets(docs, staged(ends.distinct(), "jaccard"), words)
        found = _verified(possible, sets, similarity, possible.count())
        if long is not None:
            found = found.unionByName(_in_blocks(_bundled(long), sets, similarity))
        found = staged(found, "jaccard")
        dropped(possible, sets)
        if labels is not None:
            found = found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return staged(components(found), "jaccard")

    # the same node heads most lists of a group of near copies, so they soon are one component
    heads = lists.where((F.col("node") != F.col("head")) & _fit(F.col("n"), F.col("head_n"), similarity))
    labels = joined(heads.select(F.col("node").alias("a"), F.col("head").alias("b")), None)
    current = lists.select("part", "node", "n", "of")
    for round_ in range(MAX_ROUNDS + 1):
        current = current.join(small_side(labels), "node", "left").select("part", "node", "n", "of", F.coalesce("component", "node").alias("component"))
        parts = current.groupBy("part", "component").agg(F.count(F.lit(1)).alias("c"))
        open_lists = parts.groupBy("part").agg(
            F.count(F.lit(1)).alias("components"), F.max(F.struct("c", "component")).alias("largest"), F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares")
        ).where("components > 1")
        open_lists = open_lists.select("part", F.col("largest.component").alias("main"), F.col("all").alias("m"), ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("pairs"))
        open_lists = staged(open_lists, "jaccard")
        n_open, before, left, n_long = open_lists.agg(F.count(F.lit(1)), F.lit(left), F.sum("pairs"), F.sum((F.col("m") > LONG_LIST).cast("long"))).first()
        if n_open == 0:
            return labels
        current = staged(current.join(small_side(open_lists.select("part", "main", "m"), n_open), "part"), "jaccard")
        dropped(lists, open_lists)
        lists = current
        # lists of sets that resemble each other but are not similar do not shrink by linking
        last = left <= pairs_per_entry * n_entries or left > before / 2 or round_ == MAX_ROUNDS
        if last:
            long = current.where(F.col("m") > LONG_LIST).drop("n", "of") if n_long else None
            return joined(_pairs(current.where(F.col("m") <= LONG_LIST), similarity), labels, long, judged=True)
        salt = F.pmod(F.xxhash64(F.lit(round_), "node"), F.lit(representatives))
        heads = current.groupBy("part", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64(F.lit(round_), "node").alias("h"), "node", "component", "n")).alias("head"))
        heads = heads.select("part", F.col("head.node").alias("b"), F.col("head.component").alias("b_component"), F.col("head.n").alias("b_n"))
        apart = (F.col("component") != F.col("b_component")) & _fit(F.col("n"), F.col("b_n"), similarity)
        labels = joined(current.join(heads, "part").where(apart).select(F.col("node").alias("a"), "b"), labels)
        current = current.select("part", "node", "n", "of")
    return labels


def _pairs(lists: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) in different components whose sizes and equal parts allow the similarity. In each list at least one of
    a pair lies outside the list's largest component, so the rows joined are those few against the list.

    A pair comes once from each of its lists in the larger set's scheme, so its rows count the equal parts. Those in lists
    that are not given (longer ones, compared in blocks) do not count: such pairs are compared there.
    """
    few = lists.where(F.col("component") != F.col("main")).select(
        "part", F.col("node").alias("b"), F.col("component").alias("b_component"), F.col("n").alias("b_n"), F.col("of").alias("b_of")
    )
    once = (F.col("component") == F.col("main")) | (F.col("node") < F.col("b"))
    met = lists.join(few, "part").where((F.col("component") != F.col("b_component")) & once & _fit(F.col("n"), F.col("b_n"), similarity))
    least = _least_equal(F.col("n"), F.col("b_n"), F.col("of"), F.col("b_of"), similarity).alias("least")
    rows = met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), least)
    return rows.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("equal")).where("equal >= least").select("a", "b")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id, or without id if it has none, and among different texts
    with that id the one of the smallest key. Rows equal in id and text are one document. Documents without words form no
    component and all stay."""
    who = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "key", "rows")
    copies = found.where(F.col("group").isNotNull()).groupBy("group", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    chosen = copies.groupBy("group").agg(F.min(who).alias("who")).select(F.col("who.id").alias("__id"), F.col("who.key").alias("__key"), (F.col("who.rows") > 1).alias("__several"))
    wordless = found.where(F.col("group").isNull()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.lit(False).alias("__several")).distinct()
    keep = staged(chosen.unionByName(wordless), "jaccard")
    key = text_key(F.col("text"))

    def rows(those: DataFrame, how: str) -> DataFrame:
        those = small_side(those)
        return docs.join(those, docs["doc_id"].eqNullSafe(those["__id"]) & (key == those["__key"]), how)

    # the documents that go are far fewer than those that stay, as a rule: texts are not shuffled to meet a long table
    texts = found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    same = texts["__id"].eqNullSafe(keep["__id"]) & (texts["__key"] == keep["__key"])
    several = keep.where("__several")
    gone = staged(texts.join(keep.where(~F.col("__several")), same, "left_anti"), "jaccard")
    out = rows(gone, "left_anti") if gone.count() <= keep.count() else rows(keep.where(~F.col("__several")), "left_semi")
    # only texts that repeat under one id are shuffled to be merged
    if several.isEmpty():
        return out
    return out.unionByName(rows(several, "left_semi").withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key"))
