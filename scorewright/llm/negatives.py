"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Candidates are put in the order of a Hilbert curve and written to Parquet as blocks, one row a block: its vectors, and the
smallest and largest value of each dimension (the zone map). Interval arithmetic on a zone map bounds the inner product of
an anchor with every vector of the block. An anchor first looks through its own block, which sets thresholds; zone maps,
read without the vectors, then tell which blocks can still hold a better positive, or a negative in one of its windows,
and it reads those alone. Answers are exact: what the bounds exclude cannot be among the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import dropped, staged

#: Vectors of a block, anchors of a group, zone maps compared with a group at a time.
BLOCK_ROWS = 512
GROUP_ROWS = 128
ZONES_AT_ONCE = 64
#: Bits a dimension gives to the curve, and dimensions that it runs through, those of the largest variance first.
CURVE_BITS = 4
CURVE_DIMS = 64
POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between these hundredths of its positive's.
WINDOW = (80, 100)
SCALE = 256
#: Components reach less far than this on the integer scale, so that scores of up to 512 dimensions fit 64 bits.
LARGEST = 2**27
#: Short lists a task holds before it hands them on.
HELD_LISTS = 100_000
NEVER = -(2**63)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows, 0 <= value < 2**bits) on the Hilbert curve, as rows of big-endian bytes.

    The index is found on all rows at once by undoing the curve's reflections and exchanges of axes from the highest bit
    down, and by a Gray code at the end.
    """
    x = points.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(n):
            reflect = (x[i] >> np.uint32(b)) & 1 == 1
            swapped = (x[0] ^ x[i]) & low
            x[0] ^= np.where(reflect, low, swapped)
            if i:
                x[i] ^= np.where(reflect, np.uint32(0), swapped)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint32(b)) & 1 == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    ordered = (x[None, :, :] >> shifts[:, None, None]) & 1  # the highest bits of all axes first
    return np.packbits(ordered.reshape(bits * n, -1).astype(np.uint8).T, axis=1)


def _usable(vectors: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """(id, label, dim, q): one row per id that takes part; q holds the components as integers."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(ok)
    first = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    return first.select("id", "label", F.size("v").alias("dim"), F.transform(v, lambda x: F.floor(x * float(SCALE)).cast("int")).alias("q"))


def _scales(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, in order of falling variance: axis, smallest and largest value. A row per axis reaches the driver."""
    parts = rows.select("dim", F.posexplode("q").alias("axis", "x")).groupBy("dim", "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.variance("x").alias("spread"))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["dim"], -(r["spread"] or 0.0), r["axis"])):
        out.setdefault(r["dim"], []).append((r["axis"], r["lo"], r["hi"]))
    return {dim: np.array(axes[:CURVE_DIMS], np.int64).T for dim, axes in out.items()}


def _placed(rows: DataFrame) -> DataFrame:
    """(id, label, dim, q as bytes of 32-bit integers, place): place is where the row stands on the curve of its vector length."""
    scales = _scales(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                keys = [b""] * len(q)
                if dim:
                    axes, lo, hi = scales[dim]
                    keys = [k.tobytes() for k in hilbert_keys((q[:, axes] - lo) * 2**CURVE_BITS // (hi - lo + 1), CURVE_BITS)]
                packed = [x.tobytes() for x in q.astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("dim"), pa.array(packed, pa.binary()), pa.array(keys, pa.binary())], ["id", "label", "dim", "q", "place"]
                )

    return rows.mapInArrow(run, "id long, label long, dim int, q binary, place binary")


def _ints(data: bytes, dim: int) -> np.ndarray:
    """Rows of 32-bit integers; vectors of length 0 are rows too, but their number is known from their ids alone."""
    return np.frombuffer(data, "<i4").reshape(-1, dim) if dim else np.zeros((0, 0), np.int32)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


BLOCK = "block string, dim int, lo binary, hi binary, labels binary, ids binary, row_labels binary, q binary"


def candidate_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of neighbours on the curve: zone map (lo, hi) and labels, then its rows.

    The id breaks ties of place, so that equal vectors, however many, spread over ranges and blocks.
    """
    placed = _placed(rows).repartitionByRange("dim", "place", "id").sortWithinPartitions("dim", "place", "id")

    def block(part: pa.Table) -> pa.RecordBatch:
        dim = part.column("dim")[0].as_py()
        packed = b"".join(part.column("q").to_pylist())
        x = _ints(packed, dim)
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        lo, hi = (x.min(axis=0).tobytes(), x.max(axis=0).tobytes()) if dim else (b"", b"")
        return _batch([(f"{dim}:{ids[0]}", dim, lo, hi, np.unique(labels).tobytes(), ids.tobytes(), labels.tobytes(), packed)], BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["id", "label", "dim", "q"])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows:
                dims = held.column("dim").to_numpy()
                same = int(np.searchsorted(dims, dims[0], "right"))
                if same == len(dims) < block_rows:
                    break
                yield block(held.slice(0, min(same, block_rows)))
                held = held.slice(min(same, block_rows))
        if held is not None and held.num_rows:
            yield block(held)

    return placed.mapInArrow(run, BLOCK)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision while every partial sum stays below 2**53, else in 64-bit integers."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _scores(a: bytes, b: bytes, dim: int, shape: tuple[int, int]) -> np.ndarray:
    return _product(_ints(a, dim), _ints(b, dim)) if dim else np.zeros(shape, np.int64)


def score_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any vector between each row of ``lo`` and of ``hi``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` highest scores, of equal ones those of smaller ids."""
    if len(scores) > 8 * n:
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        pool = np.flatnonzero(scores >= cut)
        return pool[np.lexsort((ids[pool], -scores[pool]))[:n]]
    return np.lexsort((ids, -scores))[:n]


ANCHOR = "id long, label long, dim int, q binary, home string, reach long, others binary"


def _anchors(blocks: DataFrame, is_anchor: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Anchors with what their own block tells: ``reach``, the score of the last of its first POSITIVES positives there, and
    the scores of all rows of other labels there, the highest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = _longs(r["ids"]), _longs(r["row_labels"])
                mine = np.flatnonzero(is_anchor(ids))
                x = _ints(r["q"], r["dim"])
                picked = x[mine].tobytes() if r["dim"] else b""
                width = 4 * r["dim"]
                out = []
                for k, (i, row) in enumerate(zip(mine.tolist(), _scores(picked, r["q"], r["dim"], (len(mine), len(ids))), strict=True)):
                    same = labels == labels[i]
                    others = np.sort(row[~same])[::-1]
                    same[i] = False
                    own = np.sort(row[same])
                    reach = int(own[-POSITIVES]) if len(own) >= POSITIVES else NEVER
                    out.append((int(ids[i]), int(labels[i]), r["dim"], picked[k * width : (k + 1) * width], r["block"], reach, others.tobytes()))
                yield _batch(out, ANCHOR)

    return blocks.select("block", "dim", "ids", "row_labels", "q").mapInArrow(run, ANCHOR)


GROUP = "dim int, ids binary, labels binary, q binary, low binary, high binary"


def _groups(wanting: DataFrame) -> DataFrame:
    """Packs anchors (id, label, dim, q, home, low, high) into rows of GROUP_ROWS neighbours on the curve.

    low and high hold the scores between which a block's must reach: POSITIVES of each an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict[str, Any]]] = {}

        def group(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            column = lambda c: b"".join(r[c] for r in rows)
            ids, labels = (np.array([r[c] for r in rows], "<i8").tobytes() for c in ("id", "label"))
            return _batch([(dim, ids, labels, column("q"), column("low"), column("high"))], GROUP)

        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["dim"], []).append(r)
                if len(held[r["dim"]]) == GROUP_ROWS:
                    yield group(r["dim"])
        for dim in list(held):
            yield group(dim)

    return wanting.mapInArrow(run, GROUP)


REQUEST = "block string, dim int, n int, ids binary, labels binary, q binary, low binary, high binary"


def _requests(groups: DataFrame, blocks: DataFrame, other_labels: bool) -> DataFrame:
    """Blocks whose bounds reach into an anchor's range, with the anchors that must read them.

    Each group of anchors meets the zone maps chunk by chunk: the stated queries against all blocks, in blocks.
    """
    zones = blocks.select("block", "dim", "lo", "hi", "labels")
    chunks = max(1, -(-zones.count() // ZONES_AT_ONCE))
    packed = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("block", "dim", "lo", "hi", "labels")).alias("zones"))
    cells = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(packed, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, ids, labels = r["dim"], _longs(r["ids"]), _longs(r["labels"])
                at = [z for z in r["zones"] if z["dim"] == dim]
                if not at:
                    continue
                a = _ints(r["q"], dim)
                low, high = (_longs(r[c]).reshape(len(ids), POSITIVES) for c in ("low", "high"))
                if dim:
                    least, most = score_bounds(a, _ints(b"".join(z["lo"] for z in at), dim), _ints(b"".join(z["hi"] for z in at), dim))
                else:
                    least = most = np.zeros((len(ids), len(at)), np.int64)
                out = []
                for k, z in enumerate(at):
                    there = _longs(z["labels"])
                    fits = (there != labels[:, None]).any(axis=1) if other_labels else np.isin(labels, there)
                    fits &= ((most[:, k, None] >= low) & (least[:, k, None] <= high) & (low <= high)).any(axis=1)
                    p = np.flatnonzero(fits)
                    if len(p):
                        out.append((z["block"], dim, len(p), ids[p].tobytes(), labels[p].tobytes(), a[p].tobytes() if dim else b"", low[p].tobytes(), high[p].tobytes()))
                if out:
                    yield _batch(out, REQUEST)

    return cells.mapInArrow(run, REQUEST)


FOUND = "anchor long, kind int, id long, score long"


def _read(requests: DataFrame, blocks: DataFrame, other_labels: bool) -> DataFrame:
    """Rows of the requested blocks among the first of an anchor's label (kind 0), or of other labels between its k-th low and high (kind k)."""
    rows = blocks.select("block", F.col("ids").alias("b_ids"), F.col("row_labels").alias("b_labels"), F.col("q").alias("b_q"))
    limit = NEGATIVES if other_labels else POSITIVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def handed() -> pa.RecordBatch:
            flat = [(a, k, i, -s) for (a, k), found in held.items() for s, i in found]
            held.clear()
            return _batch(flat, FOUND)

        for batch in batches:
            for r in batch.to_pylist():
                anchors, labels, ids, there = _longs(r["ids"]), _longs(r["labels"]), _longs(r["b_ids"]), _longs(r["b_labels"])
                low, high = (_longs(r[c]).reshape(len(anchors), POSITIVES) for c in ("low", "high"))
                for p, row in enumerate(_scores(r["q"], r["b_q"], r["dim"], (len(anchors), len(ids)))):
                    fits = there != labels[p] if other_labels else (there == labels[p]) & (ids != anchors[p])
                    for k in range(POSITIVES if other_labels else 1):
                        pool = np.flatnonzero(fits & (row >= low[p, k]) & (row <= high[p, k]))
                        if len(pool):
                            mine = held.setdefault((int(anchors[p]), k), [])
                            mine += [(-int(row[pool[i]]), int(ids[pool[i]])) for i in best(row[pool], ids[pool], limit)]
                            if len(mine) > limit:
                                mine.sort()
                                del mine[limit:]
                if len(held) > HELD_LISTS:
                    yield handed()
        if held:
            yield handed()

    found = requests.join(rows, "block").drop("block").mapInArrow(run, FOUND)
    # the limit is applied before the shuffle too
    first = Window.partitionBy("anchor", "kind").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)


def _asking(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """Anchors with their negatives' ranges: a positive's window, from below raised to the last of the first NEGATIVES that the own block holds in it."""
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(F.col("anchor").alias("id"), F.col("p.score").alias("p"))
    low, high = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lows, highs = np.ones(POSITIVES, np.int64), np.zeros(POSITIVES, np.int64)  # from above to below: empty
                there = _longs(r["others"])[::-1]
                for k, score in enumerate(r["p"]):
                    lows[k], highs[k] = -((-low * score) // 100), (high * score) // 100
                    upto = int(np.searchsorted(there, highs[k], "right"))
                    if upto >= NEGATIVES:
                        lows[k] = max(lows[k], there[upto - NEGATIVES])
                out.append((r["id"], r["label"], r["dim"], r["q"], r["home"], lows.tobytes(), highs.tobytes()))
            yield _batch(out, WANTING)

    return anchors.join(scores, "id").select("id", "label", "dim", "q", "home", "others", "p").mapInArrow(run, WANTING)


WANTING = "id long, label long, dim int, q binary, home string, low binary, high binary"


def _first_asking(anchors: DataFrame) -> DataFrame:
    """Anchors with one range, from ``reach`` up; the others are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low, high = np.ones(POSITIVES, np.int64), np.zeros(POSITIVES, np.int64)
                low[0], high[0] = r["reach"], 2**63 - 1
                out.append((r["id"], r["label"], r["dim"], r["q"], r["home"], low.tobytes(), high.tobytes()))
            yield _batch(out, WANTING)

    return anchors.select("id", "label", "dim", "q", "home", "reach").mapInArrow(run, WANTING)


def _near_each_other(wanting: DataFrame) -> DataFrame:
    """Neighbours on the curve in one task: what one of them excludes its neighbours mostly exclude too."""
    return wanting.repartitionByRange("home").sortWithinPartitions("home", "id")


def hard_negatives(vectors: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor and each of its first 5 positives the first 5 hard negatives.

    Anchors are rows whose id is divisible by ``every``. Components become floor(256 * x); scores are integer inner
    products, higher ones first, ties by smaller id. Positives are the anchor's first other rows of its label; negatives
    the first rows of other labels whose score lies within 80 to 100 hundredths of the positive's (of a positive's
    negative score none do). Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without id, label or vector, and vectors with a null or non-finite component, or one of 2**19 or more (whose
    scores need not fit 64 bits), take no part. Vectors of different lengths are not compared; empty ones score 0. Rows
    with one id are one row, the one of the smallest (label, vector). An anchor without positives, or without negatives
    for them, has no rows; an empty table gives an empty one. Extra columns of any name are ignored.
    """
    usable = staged(_usable(vectors, id, label, vector), "vectors")
    blocks = staged(candidate_blocks(usable, block_rows), "blocks")
    dropped(usable)
    anchors = staged(_anchors(blocks, lambda ids: ids % every == 0), "anchors")
    asked = _requests(_groups(_near_each_other(_first_asking(anchors))), blocks, False)
    positives = staged(_read(asked, blocks, False), "positives")
    asked = _requests(_groups(_near_each_other(_asking(anchors, positives))), blocks, True)
    negatives = _read(asked, blocks, True).select("anchor", F.col("kind").alias("nth"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    known = positives.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(known, ["anchor", "nth"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def shifted_labels(vec_id: Column, label: Column) -> Column:
    """The label a query mines with: where 7 divides the id, the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
