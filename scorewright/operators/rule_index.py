"""Any number of rules in one scan.

The comparisons of all rules are gathered in an index: per column the sorted thresholds and literals that any rule asks
for. A row's value is placed among them once, and each comparison then reads whether that place satisfies it. Rules are
evaluated on whole Arrow batches; a task hands on one row of sums per rule and group, so the shuffle holds rules x groups x
tasks rows whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scorewright.functions.rule_expr import BadRule, Leaf, Node, RuleError, leaf_sql, rule_tree

#: Rules whose masks are multiplied with the rows' values at a time.
RULES_AT_ONCE = 256

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class _Slot:
    """One column as it is sent to the tasks, and the distinct values its comparisons name."""

    column: Column
    kind: str
    values: list = field(default_factory=list)


class RuleIndex:
    """Trees of rules over numbered atoms, and the columns that the atoms read."""

    def __init__(self, df: DataFrame, rules: Sequence[str]):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.slots: dict[tuple[str, str], _Slot] = {}
        self.atoms: dict[tuple, int] = {}
        self.names: list[str] = []
        self.trees: list[Node] = []
        self.bad: list[BadRule] = []
        for rule in rules:
            try:
                tree = rule_tree(rule, self.types)
            except RuleError as exc:
                self.bad.append(BadRule(rule, str(exc)))
                continue
            self.names.append(rule)
            self.trees.append(self._numbered(tree))

    def _numbered(self, tree: Node) -> Node:
        if isinstance(tree, Leaf):
            return ("atom", self._atom(tree))
        return (tree[0], *[self._numbered(part) for part in tree[1:]])

    def _atom(self, leaf: Leaf) -> int:
        kind = self._kind(leaf)
        if kind == "flag":
            sql = leaf_sql(leaf)
            key = (sql, kind)
            self.slots.setdefault(key, _Slot(F.expr(sql).cast("tinyint"), kind))
            atom = (key, "flag", ())
        else:
            key = (leaf.column, kind)
            spark_type = {"long": "long", "double": "double", "text": "string"}[kind]
            slot = self.slots.setdefault(key, _Slot(F.col(leaf.quoted).cast(spark_type), kind))
            read = {"long": int, "double": float, "text": str}[kind]
            values = tuple(read(v) for v in leaf.values)
            slot.values += [v for v in values if v not in slot.values]
            atom = (key, leaf.op, values)
        return self.atoms.setdefault(atom, len(self.atoms))

    def _kind(self, leaf: Leaf) -> str:
        """How a comparison is indexed: among whole numbers, numbers or texts; else Spark evaluates it to a flag."""
        is_text = [isinstance(v, str) for v in leaf.values]
        of = self.types[leaf.column]
        if leaf.other is None and isinstance(of, _NUMERIC) and not any(is_text):
            return "long" if isinstance(of, _INTEGRAL) and all(isinstance(v, int) and abs(v) < 2**63 for v in leaf.values) else "double"
        if leaf.other is None and isinstance(of, T.StringType) and all(is_text) and leaf.op in ("==", "!=", "isin"):
            return "text"
        return "flag"


def _place(column: pa.Array, slot: _Slot, order: list) -> np.ndarray:
    """For each row twice the number of ``order``'s values below its own, and one more if it equals the next; -1 if missing."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if slot.kind == "text":
        coded = column.dictionary_encode()
        known = {v: 2 * i + 1 for i, v in enumerate(order)}
        table = np.array([*[known.get(v, 2 * len(order)) for v in coded.dictionary.to_pylist()], -1], np.int32)
        return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]
    x = column.fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.array(order, np.int64 if slot.kind == "long" else float)
    below = np.searchsorted(cuts, x, "left")
    out = (below + np.searchsorted(cuts, x, "right")).astype(np.int32)  # not-a-number stands above all
    out[missing] = -1
    return out


def _satisfied(op: str, values: tuple, order: list) -> np.ndarray:
    """Whether each place satisfies the comparison; the last entry is for missing values."""
    places = np.arange(2 * len(order) + 1)
    at = [2 * order.index(v) + 1 for v in values]
    if op in ("isin", "=="):
        found = np.isin(places, at)
    elif op == "!=":
        found = places != at[0]
    else:
        found = {"<": places < at[0], "<=": places <= at[0], ">": places > at[0], ">=": places >= at[0]}[op]
    return np.append(found, op == "!=")


def _masks(batch: pa.RecordBatch, slots: list[tuple[tuple, _Slot, list]], atoms: list[tuple]) -> list[np.ndarray]:
    places = {key: (batch.column(f"__s{i}"), slot, order) for i, (key, slot, order) in enumerate(slots)}
    found: dict[tuple, np.ndarray] = {}
    out = []
    for key, op, values in atoms:
        column, slot, order = places[key]
        if op == "flag":
            out.append(column.fill_null(0).to_numpy(zero_copy_only=False) == 1)
            continue
        if key not in found:
            found[key] = _place(column, slot, order)
        out.append(_satisfied(op, values, order)[found[key]])
    return out


#: The rule that every row hits, at position -1 of the sums.
EVERY_ROW = ("every",)


def _evaluated(tree: Node, masks: list[np.ndarray], n: int) -> np.ndarray:
    kind, *parts = tree
    if kind == "every":
        return np.ones(n, bool)
    if kind == "atom":
        return masks[parts[0]]
    if kind == "not":
        return ~_evaluated(parts[0], masks, n)
    out = _evaluated(parts[0], masks, n)
    for part in parts[1:]:
        out = (out & _evaluated(part, masks, n)) if kind == "and" else (out | _evaluated(part, masks, n))
    return out


def rule_sums(df: DataFrame, rules: Sequence[str], values: Mapping[str, Column], by: str | None = None) -> tuple[DataFrame, RuleIndex]:
    """(pos, by, n, sums): for each rule, and each value of the column ``by``, the rows it hits and the sums of ``values`` over them.

    One scan of the columns that the rules and values read, whatever the number of rules. Missing values count as 0 in the
    sums; a comparison with a missing value is false (true for ``!=``), as everywhere. Rules that hit nothing have no row;
    rules that cannot be read are in the index's ``bad``. ``pos`` counts the others in order; -1 stands for all rows.
    """
    index = RuleIndex(df, rules)
    slots = [(key, slot, sorted(slot.values)) for key, slot in index.slots.items()]
    plain = [(key, _Slot(None, slot.kind), order) for key, slot, order in slots]
    atoms, trees, names = list(index.atoms), [EVERY_ROW, *index.trees], list(values)
    group = F.col(f"`{by}`") if by else F.lit(None).cast("string")
    group_type = df.schema[by].dataType.simpleString() if by else "string"
    sent = df.select(group.alias("__by"), *[slot.column.alias(f"__s{i}") for i, (_, slot, _) in enumerate(slots)], *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"__v{i}") for i, v in enumerate(values.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            masks = _masks(batch, plain, atoms)
            coded = batch.column("__by").dictionary_encode(null_encoding="encode")
            groups, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(f"__v{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]])
            rows = [np.flatnonzero(code == g) for g in range(len(groups))] if len(groups) > 1 else [slice(None)]
            for a in range(0, len(trees), RULES_AT_ONCE):
                hit = np.stack([_evaluated(t, masks, batch.num_rows) for t in trees[a : a + RULES_AT_ONCE]])
                for g, at in zip(groups, rows, strict=True):
                    held.setdefault(g, np.zeros((len(trees), x.shape[1])))[a : a + RULES_AT_ONCE] += _sums(hit[:, at], x[at])
        for g, sums in held.items():
            at = np.flatnonzero(sums[:, 0])
            columns = [pa.array(at - 1, pa.int32()), pa.array([g] * len(at), by_type), pa.array(sums[at, 0].astype(np.int64)), *[pa.array(sums[at, i + 1]) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "__by", "n", *names])

    by_type = to_arrow_type(sent.schema["__by"].dataType)
    schema = ", ".join(["pos int", f"`__by` {group_type}", "n long", *[f"`{c}` double" for c in names]])
    parts = sent.mapInArrow(run, schema)
    keys = ["pos", "__by"] if by else ["pos"]
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return (sums.withColumnRenamed("__by", by) if by else sums), index


def rule_products(df: DataFrame, rules: Sequence[str]) -> tuple[DataFrame, RuleIndex]:
    """(i, j, common): rows that rules i <= j both hit, for the pairs that share any; i = j gives a rule's own hits.

    One scan as in ``rule_sums``; a task hands on one row per pair that occurs in it, and no pair is formed without a row.
    """
    index = RuleIndex(df, rules)
    slots = [(key, slot, sorted(slot.values)) for key, slot in index.slots.items()]
    plain = [(key, _Slot(None, slot.kind), order) for key, slot, order in slots]
    atoms, trees = list(index.atoms), index.trees
    sent = df.select(*[slot.column.alias(f"__s{i}") for i, (_, slot, _) in enumerate(slots)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros((len(trees), len(trees)), np.int64)
        for batch in batches:
            if batch.num_rows and trees:
                masks = _masks(batch, plain, atoms)
                hit = np.stack([_evaluated(t, masks, batch.num_rows) for t in trees])
                some = np.flatnonzero(hit.any(axis=1))
                for a in range(0, len(some), RULES_AT_ONCE):
                    left = hit[some[a : a + RULES_AT_ONCE]].astype(np.float32)
                    for b in range(a, len(some), RULES_AT_ONCE):
                        right = hit[some[b : b + RULES_AT_ONCE]].astype(np.float32)
                        common[np.ix_(some[a : a + RULES_AT_ONCE], some[b : b + RULES_AT_ONCE])] += np.rint(left @ right.T).astype(np.int64)
        i, j = np.nonzero(np.triu(common))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(common[i, j])], ["i", "j", "common"])

    parts = sent.mapInArrow(run, "i int, j int, common long")
    return parts.groupBy("i", "j").agg(F.sum("common").alias("common")), index


def _sums(hit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per rule the sums of each value over the rows it hits; infinities and not-a-number of other rows stay out."""
    if np.isfinite(x).all():
        return hit.astype(float) @ x
    return np.stack([x[h].sum(axis=0) for h in hit])
