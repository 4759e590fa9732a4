"""Rule text to Spark Columns.

A rule such as ``(age <= 30) & (income > 50000)`` is checked against a whitelist
of leaves and connectors, its leaves get SQL spelling, and Spark's own expression
parser does the rest; ``rule_tree`` gives the same as a tree. Column names may hold
any character. Comparisons with a missing value are false (true for
``!=``), as in a pandas mask, so negation stays two-valued.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_STR = r"'[^'\\]*'|\"[^\"\\]*\""
_IDENT = r"[^\W\d]\w*"
_ITEM = re.compile(rf"\s*({_NUM}|{_STR})\s*(?:,|$)")
_CONNECTIVES = {"&": " AND ", "|": " OR ", "~": " NOT "}


class RuleError(ValueError):
    """The rule text is outside the supported grammar or names an unknown column."""


@dataclass(frozen=True)
class BadRule:
    rule: str
    error: str


@dataclass(frozen=True)
class Leaf:
    """One comparison: a column with literals, or with another column."""

    column: str
    op: str
    values: tuple = ()
    other: str | None = None

    @property
    def quoted(self) -> str:
        return _quoted(self.column)


#: A leaf, or ("and" | "or", part, ...) or ("not", part).
Node = Leaf | tuple


@lru_cache(maxsize=64)
def _leaf_pattern(columns: frozenset[str]) -> re.Pattern:
    """Comparisons over these columns. Names that are no identifiers (spaces, hyphens, dots) are known by the columns alone, longer ones first."""
    odd = sorted((c for c in columns if not re.fullmatch(_IDENT, c)), key=lambda c: (-len(c), c))
    name = "|".join([*map(re.escape, odd), _IDENT])
    return re.compile(
        rf"(?P<left>{name})\s*(?:(?P<op><=|>=|==|!=|<|>)\s*(?:(?P<right>{_NUM}|{_STR})|(?P<other>{name}))"
        rf"|\.isin\(\s*\[(?P<items>[^\[\]]*)\]\s*\))"
    )


def _value(text: str) -> str | int | float:
    if text[0] in "'\"":
        return text[1:-1]
    return float(text) if re.search(r"[eE.]", text) else int(text)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value: str | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def _leaf(m: re.Match, columns: frozenset[str]) -> Leaf:
    names = [m["left"], *([m["other"]] if m["other"] else [])]
    if m["items"] is not None:
        body, pos, items = m["items"], 0, []
        while pos < len(body):
            it = _ITEM.match(body, pos)
            if not it:
                raise RuleError(f"list holds something other than literals: [{body}]")
            items.append(_value(it[1]))
            pos = it.end()
        leaf = Leaf(m["left"], "isin", tuple(items))
    else:
        leaf = Leaf(m["left"], m["op"], () if m["other"] else (_value(m["right"]),), m["other"])
    unknown = [n for n in names if n not in columns]
    if unknown:
        raise RuleError(f"unknown column: {', '.join(unknown)}")
    return leaf


def leaf_sql(leaf: Leaf) -> str:
    """Comparisons with a missing value are false, ``!=`` is true."""
    left = _quoted(leaf.column)
    if leaf.op == "isin":
        sql = f"{left} IN ({', '.join(map(_literal, leaf.values))})" if leaf.values else "false"
    else:
        op = {"==": "=", "!=": "<>"}.get(leaf.op, leaf.op)
        sql = f"{left} {op} {_quoted(leaf.other) if leaf.other else _literal(leaf.values[0])}"
    return f"coalesce({sql}, {'true' if leaf.op == '!=' else 'false'})"


def _tokens(rule: str, columns: Iterable[str]) -> list[Leaf | str]:
    cols = frozenset(columns)
    pattern = _leaf_pattern(cols)
    out: list[Leaf | str] = []
    pos, depth = 0, 0
    text = rule.strip()
    while pos < len(text):
        ch = text[pos]
        m = None if ch in "()&|~" or ch.isspace() else pattern.match(text, pos)
        if m:
            out.append(_leaf(m, cols))
            pos = m.end()
            continue
        if ch in "&|~()":
            depth += (ch == "(") - (ch == ")")
            out.append(ch)
        elif not ch.isspace():
            raise RuleError(f"unexpected text at position {pos}: {text[pos:pos + 20]!r}")
        if depth < 0:
            raise RuleError("unbalanced parentheses")
        pos += 1
    if depth:
        raise RuleError("unbalanced parentheses")
    if not any(isinstance(t, Leaf) for t in out):
        raise RuleError("no condition found")
    return out


def rule_tree(rule: str, columns: Iterable[str]) -> Node:
    """The rule as a tree; ``~`` binds before ``&``, which binds before ``|``. Raises ``RuleError`` on anything unexpected."""
    waiting: list[str] = []
    found: list[Node] = []
    binds = {"|": 1, "&": 2, "~": 3}

    def reduce() -> None:
        op = waiting.pop()
        if op == "~":
            found.append(("not", found.pop()))
            return
        right, left = found.pop(), found.pop()
        name = "and" if op == "&" else "or"
        parts = left[1:] if isinstance(left, tuple) and left[0] == name else (left,)
        found.append((name, *parts, right))

    operand = True  # whether a condition is due, or an operator
    for token in _tokens(rule, columns):
        opens = isinstance(token, Leaf) or token in ("(", "~")
        if opens != operand:
            raise RuleError("a condition is due" if operand else "conditions without & or | between them")
        if isinstance(token, Leaf):
            found.append(token)
            operand = False
        elif opens:
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and binds[waiting[-1]] >= binds[token]:
                reduce()
            waiting.append(token)
            operand = True
    if operand:
        raise RuleError("a condition is due")
    while waiting:
        reduce()
    return found[0]


def rule_sql(rule: str, columns: Iterable[str]) -> str:
    """Spark SQL text of a rule; raises ``RuleError`` on anything unexpected."""
    return "".join(leaf_sql(t) if isinstance(t, Leaf) else _CONNECTIVES.get(t, t) for t in _tokens(rule, columns))


def rule_column(rule: str, columns: Iterable[str]) -> Column:
    sql = rule_sql(rule, columns)
    try:
        return F.expr(sql)
    except Exception as exc:  # malformed connective order
        raise RuleError(str(exc).splitlines()[0]) from exc


def compile_rules(rules: Sequence[str], columns: Iterable[str]) -> tuple[list[tuple[str, Column]], list[BadRule]]:
    """Compiled rules in order, and the ones that failed with their reason."""
    cols = list(columns)
    good, bad = [], []
    for r in rules:
        try:
            good.append((r, rule_column(r, cols)))
        except RuleError as exc:
            bad.append(BadRule(r, str(exc)))
    return good, bad


def any_of(hits: Sequence[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def build_expression(feature: str, operator: str, threshold) -> str:
    """Structured rule (feature, operator, threshold) to rule text; literals only."""
    op = str(operator).strip().lower()
    if op == "between":
        bounds = threshold
        if isinstance(bounds, str):
            try:
                bounds = ast.literal_eval(bounds)
            except (ValueError, SyntaxError) as exc:
                raise RuleError(f"between needs [min, max], got {threshold}") from exc
        if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
            raise RuleError(f"between needs [min, max], got {threshold}")
        return f"({feature} >= {bounds[0]}) & ({feature} <= {bounds[1]})"
    if op in ("in", "not in"):
        items = threshold if isinstance(threshold, str) and threshold.strip().startswith("[") else None
        if items is None:
            items = str(list(threshold)) if isinstance(threshold, (list, tuple)) else f"[{threshold}]"
        return f"({'~' if op == 'not in' else ''}{feature}.isin({items}))"
    if op not in (">", ">=", "<", "<=", "==", "!="):
        raise RuleError(f"unknown operator: {operator}")
    value = threshold
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            value = f"'{value}'"
    return f"({feature} {op} {value})"
