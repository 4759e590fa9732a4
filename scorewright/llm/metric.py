"""Near-duplicate vectors by an exact metric range join.

Pivots cut the unit sphere into cells of nearest pivot. A pair within the radius lies in one cell or across a border no
farther than the radius from both, so a vector also visits each higher-numbered cell whose border is that near (the
triangle inequality; between unit vectors the border is a plane, and its distance is exact). Cells then join on their
own, each pair in one place, cut into blocks of bounded size whatever the cell holds. A block returns link counts and a
spanning forest instead of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import small_side, staged
from scorewright.llm.components import components

COSINE = 0.95
#: Mean vectors of a cell, until there are MAX_PIVOTS cells, which then grow; pivots are drawn from SAMPLE vectors.
CELL_ROWS = 4096
MAX_PIVOTS = 1024
SAMPLE = 4096
#: Vectors of one side of a block, and how many of them are compared with the other side at a time.
BLOCK_ROWS = 4096
STRIP_ROWS = 512
SLACK = 1e-9


def _usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column scaled to length 1; scaled by the largest part first, so squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows at most, each the farthest from those before; equal rows once."""
    chosen = [0]
    near = 2 - 2 * x @ x[0]
    while len(chosen) < n and near.max() > SLACK:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 2 - 2 * x @ x[chosen[-1]])
    return x[chosen]


def _pivots(vectors: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension, from SAMPLE vectors drawn by hash."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", F.size("v").alias("dim")).toArrow()
    dims = sample.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        part = sample.filter(pa.array(dims == dim)).column("v").combine_chunks()
        out[dim] = _far_apart(_units(part, dim), min(MAX_PIVOTS, -(-n // cell_rows)))
    return out


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(id, v, dim, cell, home): each vector in its own cell and in those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                p = pivots.get(dim)
                if p is None:  # no vector of this length was drawn: one cell
                    row, cell, home = np.arange(part.num_rows), np.zeros(part.num_rows, int), np.ones(part.num_rows, bool)
                else:
                    near = _units(part.column("v"), dim) @ p.T
                    own = near.argmax(axis=1)
                    gap = near[np.arange(len(own)), own][:, None] - near
                    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[own]
                    reach = (gap <= radius * apart + SLACK) & (np.arange(len(p)) > own[:, None])
                    reach[np.arange(len(own)), own] = True
                    row, cell = np.nonzero(reach)
                    home = cell == own[row]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("id"), taken.column("v"), taken.column("dim"), pa.array(cell, pa.int32()), pa.array(home)], ["id", "v", "dim", "cell", "home"]
                )

    return vectors.mapInArrow(run, "id long, v array<double>, dim int, cell int, home boolean")


def _blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Copies each row to the blocks it takes part in: ``left`` block of the home rows against ``right`` block of the
    home rows (kind 0, left <= right) or of the visitors (kind 1)."""
    count = lambda home: F.count(F.when(F.col("home") == home, 1))
    parts = placed.groupBy("dim", "cell").agg(F.ceil(count(True) / block_rows).cast("int").alias("homes"), F.ceil(count(False) / block_rows).cast("int").alias("guests"))
    # a row per cell: MAX_PIVOTS rows for each vector length drawn, one for any other
    df = placed.join(small_side(staged(parts, "vectors")), ["dim", "cell"])
    n = F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))
    df = df.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), n).cast("int"))
    block = lambda kind, left, right, first: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), first.alias("first"))
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("own")
    with_homes = F.transform(upto(F.col("homes")), lambda o: block(0, F.least(own, o), F.greatest(own, o), own <= o))
    with_guests = F.transform(upto(F.col("guests")), lambda g: block(1, own, g, F.lit(True)))
    as_guest = F.transform(upto(F.col("homes")), lambda h: block(1, h, own, F.lit(False)))
    to = F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)
    return df.select("id", "v", "dim", "cell", F.explode(to).alias("t")).select("id", "v", "dim", "cell", "t.*")


class _Forest:
    """Components of links that arrive in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (deeper := self.label[self.label]).tolist() != self.label.tolist():
                self.label = deeper


def _join(table: pa.Table, cosine: float) -> pa.Table:
    """One block: per vector with links their number and, for all but one of each component, a vector it is connected with."""
    dim = table.column("dim")[0].as_py()
    first = table.column("first").to_numpy()
    same = table.column("kind")[0].as_py() == 0 and table.column("left")[0].as_py() == table.column("right")[0].as_py()
    x = _units(table.column("v").combine_chunks(), dim)
    ids = table.column("id").to_numpy()
    a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    n = np.zeros(len(ids), np.int64)
    forest = _Forest(len(ids))
    other = x[b].T
    for i in range(0, len(a), STRIP_ROWS):
        strip = a[i : i + STRIP_ROWS]
        r, c = np.nonzero(x[strip] @ other >= cosine)
        r, c = strip[r], b[c]
        if same:
            r, c = r[r < c], c[r < c]
        n += np.bincount(r, minlength=len(ids)) + np.bincount(c, minlength=len(ids))
        forest.add(r, c)
    linked = np.flatnonzero(n)
    root = forest.label[linked]
    return pa.table({"id": ids[linked], "n": n[linked], "to": pa.array(ids[root], pa.int64(), mask=root == linked)})


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is ``cosine`` or more. Vectors that are null, empty, zero or
    hold null or non-finite parts, and rows without id, link with nothing; vectors of different lengths do not link.
    Rows with one id are one vector (the smallest of theirs) and do not link with each other. kept: the id is its
    component's smallest; false for a null id, whose component is null. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = staged(rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    radius = float(np.sqrt(2 - 2 * cosine))
    placed = staged(_placed(usable, _pivots(usable, cell_rows), radius), "vectors")
    blocks = _blocks(placed, block_rows)
    found = staged(blocks.groupBy("dim", "cell", "kind", "left", "right").applyInArrow(lambda t: _join(t, cosine), "id long, n long, to long"), "vectors")
    degrees = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.where(F.col("to").isNotNull()).select(F.col("id").alias("a"), F.col("to").alias("b")))
    out = rows.select("id").join(degrees, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
