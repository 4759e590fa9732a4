"""Exact order statistics and quantiles without gathering a column in one task.

Wanted ranks are found by refining a histogram: each pass is one scan with
map-side aggregation, the driver sees a bounded number of cell counts,
and once few rows are left in the open cells their value counts finish the job.
Infinities lie in no cell: two counts settle their ranks beforehand. The path is
the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.operators.histogram import clean_double

# Rows left in the open cells of a quantile search up to which their value counts finish it.
BUFFER_ROWS = 100_000
# Distinct values the driver may take to settle the last open cells.
FINISH_ROWS = 100_000
# Histogram cells of one pass over all columns.
CELLS = 20_000
# Tied rows up to which the driver may take the smallest ones directly.
TAKE_ROWS = 10_000

Span = tuple[int, float | None, float | None]
Probs = Sequence[float] | Mapping[str, Sequence[float]]


class Element(NamedTuple):
    """A value in sorted order, the rows before it and the rows equal to it."""

    value: float
    below: int
    same: int


class _Cell(NamedTuple):
    low: float
    high: float
    below: int
    n: int
    ranks: list[int]


def column_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, Span]:
    """(non-null count, min, max) per column, one scan."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = clean_double(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


class _Ends(NamedTuple):
    """Rows of a column, those equal to -inf and to +inf, and the range of the others."""

    n: int
    first: int
    last: int
    low: float | None
    high: float | None


def _finite_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, _Ends]:
    """One scan."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = clean_double(c)
        finite = F.when(F.abs(x) < math.inf, x)
        aggs += [
            F.count(x).alias(f"n{i}"), F.count_if(x == -math.inf).alias(f"f{i}"), F.count_if(x == math.inf).alias(f"l{i}"),
            F.min(finite).alias(f"a{i}"), F.max(finite).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    return {c: _Ends(*[row[f"{k}{i}"] for k in "nflab"]) for i, c in enumerate(cols)}


def _disjoint(cells: list[_Cell]) -> list[_Cell]:
    """Cells in order, neighbours with no double between them joined into one."""
    out: list[_Cell] = []
    for k in sorted(cells):
        if out and math.nextafter(out[-1].high, math.inf) >= k.low:
            p = out[-1]
            out[-1] = _Cell(p.low, k.high, p.below, p.n + k.n, p.ranks + k.ranks)
        else:
            out.append(k)
    return out


def _inside(df: DataFrame, cells: Mapping[str, list[_Cell]]) -> DataFrame:
    """(fid, cell, value) of the values inside each column's cells; fid is the column's position."""
    base = df.select(*[clean_double(c).alias(f"x{i}") for i, c in enumerate(cells)])
    many = [i for i, ks in enumerate(cells.values()) if len(ks) > 1]
    if many:
        edges = [[e for k in list(cells.values())[i] for e in (k.low, math.nextafter(k.high, math.inf))] for i in many]
        base = Bucketizer(
            inputCols=[f"x{i}" for i in many], outputCols=[f"b{i}" for i in many],
            splitsArray=[[-math.inf, *e, math.inf] for e in edges], handleInvalid="keep",
        ).transform(base)
    parts = []
    for i, ks in enumerate(cells.values()):
        # edges alternate start, end: odd bins are inside
        if len(ks) > 1:
            at = f"CASE WHEN b{i} % 2 = 1 THEN CAST((b{i} - 1) / 2 AS INT) END"
        else:
            at = f"CASE WHEN x{i} >= {ks[0].low!r}D AND x{i} <= {ks[0].high!r}D THEN 0 END"
        parts.append(f"{i}, {at}, x{i}")
    return base.select(F.expr(f"stack({len(parts)}, {', '.join(parts)}) AS (fid, cell, value)")).where("cell IS NOT NULL")


def _doubles(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _subdivide(df: DataFrame, cells: Mapping[str, list[_Cell]], resolution: int) -> dict[str, list[_Cell]]:
    """Each cell cut into equal widths: the non-empty parts with count, min and max, from one scan."""
    ks = list(cells.values())
    per = [max(8, resolution // len(k)) for k in ks]
    # flat lists over (column, cell): where it starts and how wide a part is
    start = [0]
    for k in ks:
        start.append(start[-1] + len(k))
    lows = [c.low for k in ks for c in k]
    widths = [(c.high / n - c.low / n) or (c.high - c.low) or 1.0 for k, n in zip(ks, per) for c in k]
    flat = f"element_at(array({', '.join(map(str, start))}), fid + 1) + cell + 1"
    long = _inside(df, cells).withColumn("k", F.expr(flat))
    part = f"CAST(least(floor((value - element_at({_doubles(lows)}, k)) / element_at({_doubles(widths)}, k)), element_at(array({', '.join(map(str, per))}), fid + 1) - 1) AS INT)"
    rows = (
        long.groupBy("fid", "cell", F.expr(part).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    )
    names = list(cells)
    out: dict[str, list[_Cell]] = {c: [] for c in cells}
    below: dict[tuple[int, int], int] = {}
    for r in sorted(rows, key=lambda r: (r["fid"], r["cell"], r["part"])):
        c = names[r["fid"]]
        at = below.setdefault((r["fid"], r["cell"]), cells[c][r["cell"]].below)
        out[c].append(_Cell(r["low"], r["high"], at, r["n"], []))
        below[(r["fid"], r["cell"])] += r["n"]
    return out


def select_ranks(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int] | Callable[[int], Sequence[int]]],
    bounds: Mapping[str, tuple[float, float]] | None = None,
    resolution: int | None = None,
    finish_rows: int = FINISH_ROWS,
) -> dict[str, dict[int, Element]]:
    """0-based rank -> element per column. Ranks may be a function of the column's row count;
    known ``bounds`` of the values save the scan that looks for them."""
    resolution = resolution or max(1000, CELLS // max(1, len(ranks)))
    # an infinite bound does not say how many rows lie on it
    bounds = {c: b for c, b in (bounds or {}).items() if all(map(math.isfinite, b))}
    ends = _finite_ranges(df, [c for c in ranks if c not in bounds])
    bounds.update({c: (e.low, e.high) for c, e in ends.items() if e.low is not None})
    found: dict[str, dict[int, Element]] = {c: {} for c in ranks}
    still = {c: [_Cell(float(lo), float(hi), ends[c].first if c in ends else 0, 0, [])] for c, (lo, hi) in bounds.items() if c in ranks}
    wanted: dict[str, list[int]] = {}
    for c, e in ends.items():
        asked = ranks[c](e.n) if callable(ranks[c]) else ranks[c]
        wanted[c] = sorted({r for r in asked if 0 <= r < e.n})
        found[c].update({r: Element(-math.inf, 0, e.first) for r in wanted[c] if r < e.first})
        found[c].update({r: Element(math.inf, e.n - e.last, e.last) for r in wanted[c] if r >= e.n - e.last})
    still = {c: cells for c, cells in still.items() if c not in ends or set(wanted[c]) - set(found[c])}
    while still:
        nxt: dict[str, list[_Cell]] = {}
        for c, cells in _subdivide(df, still, resolution).items():
            if c not in wanted:
                n = sum(k.n for k in cells)
                asked = ranks[c](n) if callable(ranks[c]) else ranks[c]
                wanted[c] = sorted({r for r in asked if 0 <= r < n})
            todo = [r for r in wanted[c] if r not in found[c]]
            left = []
            for k in cells:
                inside = [r for r in todo if k.below <= r < k.below + k.n]
                if inside and k.low == k.high:
                    found[c].update(dict.fromkeys(inside, Element(k.low, k.below, k.n)))
                elif inside:
                    left.append(k._replace(ranks=inside))
            if left:
                nxt[c] = _disjoint(left)
        still = nxt
        if sum(k.n for ks in still.values() for k in ks) <= finish_rows:
            _finish(df, still, found)
            break
    return found


def _finish(df: DataFrame, still: Mapping[str, list[_Cell]], found: dict[str, dict[int, Element]]) -> None:
    """Value counts of the open cells settle the remaining ranks."""
    if not still:
        return
    names = list(still)
    rows = _inside(df, still).groupBy("fid", "cell", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    below: dict[tuple[int, int], int] = {}
    for r in sorted(rows, key=lambda r: (r["fid"], r["cell"], r["value"])):
        c = names[r["fid"]]
        k = still[c][r["cell"]]
        at = below.setdefault((r["fid"], r["cell"]), k.below)
        found[c].update({q: Element(r["value"], at, r["n"]) for q in k.ranks if at <= q < at + r["n"]})
        below[(r["fid"], r["cell"])] += r["n"]


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], **options) -> dict[str, dict[int, float]]:
    """0-based rank -> value for each column, exact."""
    return {c: {r: e.value for r, e in found.items()} for c, found in select_ranks(df, ranks, **options).items()}


def _interpolated(a: float, b: float, part: float) -> float | None:
    """The number ``part`` of the way from a to b; none between -inf and +inf."""
    if a == b or part == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        return None if math.isinf(a) and math.isinf(b) else a if math.isinf(a) else b
    return a + (b - a) * part if math.isfinite(b - a) else a * (1 - part) + b * part


def quantiles(df: DataFrame, cols: Sequence[str], probs: Probs, buffer_rows: int = BUFFER_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (the numpy default); ``probs`` for all columns or per column."""
    cols = list(cols)
    if not cols:
        return {}
    per = {c: [float(p) for p in (probs[c] if isinstance(probs, Mapping) else probs)] for c in cols}
    spans = column_ranges(df, cols)
    out: dict[str, list[float | None]] = {c: [None] * len(per[c]) for c in cols}
    live = [c for c in cols if spans[c][0] and per[c]]
    if not live:
        return out
    at = {c: [p * (spans[c][0] - 1) for p in per[c]] for c in live}
    ranks = {c: [r for p in at[c] for r in (math.floor(p), math.ceil(p))] for c in live}
    values = order_statistics(df, ranks, bounds={c: spans[c][1:] for c in live}, finish_rows=buffer_rows)
    for c in live:
        v = values[c]
        out[c] = [_interpolated(v[math.floor(p)], v[math.ceil(p)], p - math.floor(p)) for p in at[c]]
    return out


# ---------------------------------------------------------------- rows by keys of any type

#: Bytes of a text that one number holds exactly.
PIECE = 6
#: Whole numbers below this are exact as doubles.
EXACT = 2**53

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


class RowOrder:
    """Rows in order of columns of any type, compared left to right; missing values and not-a-number come first.

    Numbers and times compare by value (long integers and decimals exactly), texts and binaries byte by byte. No sort and
    no window is needed: the k-th row's key is selected column by column, a text six bytes at a time as one number, each
    time among the rows still tied; a short tie is finished by a bounded top-k.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.values = [self._value(f"`{c}`", df.schema[c].dataType) for c in columns]
        self.df = df.select(*[v.alias(f"k{i}") for i, v in enumerate(self.values)])
        self.types = [f.dataType for f in self.df.schema.fields]

    @staticmethod
    def _value(name: str, of: T.DataType) -> Column:
        x = F.col(name)
        if isinstance(of, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(x), x.cast("double"))
        if isinstance(of, _WHOLE):
            return x.cast("long")
        if isinstance(of, T.DateType):
            return F.unix_date(x).cast("long")
        if isinstance(of, T.TimestampType):
            return F.unix_micros(x)
        if isinstance(of, T.TimestampNTZType):
            return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if isinstance(of, (T.DecimalType, T.StringType, T.BinaryType)):
            return x
        raise TypeError(f"{name} has no order: {of.simpleString()}")

    def kth(self, k: int) -> tuple | None:
        """Key of the k-th row (0-based), cut after the first column that settles it; None beyond the last row."""
        names, key, tied = self.df.columns, [], self.df
        for i, c in enumerate(names):
            numeric = isinstance(self.types[i], (T.LongType, T.DoubleType, T.DecimalType))
            for piece, last in self._numbers(c) if numeric else self._pieces(c):
                at = F.coalesce(piece, F.lit(-math.inf))
                hit = select_ranks(tied.select(at.alias("v")), {"v": [k]})["v"].get(k)
                if hit is None:
                    return None
                k -= hit.below
                tied = tied.where(at == F.lit(hit.value))
                if hit.same <= TAKE_ROWS:
                    if hit.same == 1 or i == len(names) - 1:
                        return (*key, tied.select(*names[i:]).orderBy(*names[i:]).limit(k + 1).collect()[k][0])
                    return (*key, *tied.select(*names[i:]).orderBy(*names[i:]).limit(k + 1).collect()[k])
                if hit.value == -math.inf:
                    missing = tied.where(F.col(c).isNull())
                    n = missing.count()
                    tied, k = (missing, k) if k < n else (tied.where(F.col(c).isNotNull()), k - n)
                    break
                if last(hit.value, tied):
                    break
            key.append(tied.select(F.min(c)).first()[0])
        return tuple(key)

    def _numbers(self, c: str):
        """A number as the nearest double, then what that leaves; whole numbers below 2^53 leave nothing."""
        x = F.col(c)
        near = x.cast("double")
        if isinstance(self.df.schema[c].dataType, T.DoubleType):
            yield near, lambda v, tied: True
            return
        yield near, lambda v, tied: isinstance(self.df.schema[c].dataType, T.LongType) and abs(v) < EXACT
        scale = getattr(self.df.schema[c].dataType, "scale", 0)
        left = x.cast(f"decimal(38,{scale})") - near.try_cast(f"decimal(38,{scale})")
        yield left.cast("double"), lambda v, tied: True

    @staticmethod
    def _pieces(c: str):
        """A text as numbers of six bytes each, short ones filled with zeros, then its length."""
        raw = F.col(c).cast("binary")
        done, at = False, 0

        def ended(_, tied: DataFrame) -> bool:
            nonlocal done
            done = (tied.agg(F.max(F.octet_length(raw))).first()[0] or 0) <= PIECE * at
            return False

        while not done:
            at += 1
            piece = F.rpad(F.hex(F.substring(raw, PIECE * (at - 1) + 1, PIECE)), 2 * PIECE, "0")
            yield F.conv(piece, 16, 10).cast("double"), ended
        yield F.octet_length(raw).cast("double"), lambda v, tied: True

    def at_or_after(self, key: Sequence) -> Column:
        """Row-wise test: the row's leading columns >= key. Never null."""
        cond = F.lit(True)
        for x, v in list(zip(self.values, key))[::-1]:
            if v is None:
                later, equal = x.isNotNull(), x.isNull()
            else:
                at = F.lit(v)
                later, equal = F.coalesce(x > at, F.lit(False)), x.eqNullSafe(at)
            cond = later | (equal & cond)
        return cond
