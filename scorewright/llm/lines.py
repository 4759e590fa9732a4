"""Removal of repeated runs of lines by winnowing, in DataFrame operations only.

A run is WINDOW_LINES lines that follow each other, or one line of LONG_LINE_WORDS words. Of the hashes in every window of
lines the smallest is selected, and so is every long line: a repeat holds a selected line, at the same place in both of
its occurrences, so selected lines are the only fingerprints that are kept. Their positions are joined: one whose line is
selected in one place only is no part of a repeat. A match is extended to both sides over the windows that hold its line,
and windows overlap, so runs of any length are followed to their ends. Of equal runs all but the first are deleted.
Runs are compared by 128 bits of hashes of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import WORD, dropped, staged, text_key

WINDOW_LINES = 2
#: A line of so many words is a run by itself.
LONG_LINE_WORDS = 5
#: Names on more runs than this, and than one in HEAVY_SHARE of all, are joined by broadcast: there are HEAVY_SHARE of them at most.
HEAVY_ROWS = 1000
HEAVY_SHARE = 100_000


def _lines(text: Column) -> Column:
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _run(i: Column, width: int) -> Column:
    """Start, width and 128-bit name of the run of ``width`` lines from line ``i``."""
    names = [F.xxhash64(F.lit(width), F.slice(h, i + 1, width)).alias(n) for h, n in (("h", "name"), ("g", "check"))]
    return F.struct(i.cast("int").alias("start"), F.lit(width).alias("width"), *names)


def _selected(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """(order, key, sign, line, runs): each selected line with the runs it stands for, those whose smallest hash it has first."""
    lines = docs.withColumn("lines", _lines(F.col("text"))).where(F.size("lines") > 0)
    hashed = lines.select(
        "order", "key", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.xxhash64(F.lit(8), x)).alias("g"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)) >= long_words).alias("long"),
    )
    last = F.size("h") - window
    none = F.array().cast("array<int>")

    def least(s: Column) -> Column:
        hashes = F.slice("h", s + 1, window)
        return s + F.array_position(hashes, F.array_min(hashes)) - 1

    def fingerprint(i: Column) -> Column:
        low, high = F.greatest(i - window + 1, F.lit(0)), F.least(i, last)
        starts = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(none), lambda s: least(s) == i)
        several = F.transform(starts, lambda s: _run(s, window))
        single = F.when(F.get("long", i), F.array(_run(i, 1))).otherwise(F.array().cast("array<struct<start:int,width:int,name:bigint,check:bigint>>"))
        return F.struct(F.get("h", i).alias("sign"), i.alias("line"), (F.concat(several, single) if window > 1 else single).alias("runs"))

    found = F.transform(F.sequence(F.lit(0), F.size("h") - 1), fingerprint)
    return hashed.select("order", "key", F.explode(F.filter(found, lambda f: F.size(f["runs"]) > 0)).alias("f")).select("order", "key", "f.*")


def _later(live: DataFrame) -> DataFrame:
    """Runs (order, key, start, width) that are not the first of their name. Names on many runs are joined by broadcast, so no task gets all of one."""
    names = ["name", "check", "width"]
    place = F.struct("order", "key", "start")
    firsts = staged(live.groupBy(*names).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "lines")
    total = live.count()
    heavy = F.broadcast(firsts.where(F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE)).select(*names, F.col("first").alias("heavy_first")))
    marked = live.join(heavy, names, "left")
    light = marked.where(F.col("heavy_first").isNull()).join(firsts.select(*names, "first"), names)
    of_heavy = marked.where(F.col("heavy_first").isNotNull()).withColumnRenamed("heavy_first", "first")
    both = [df.where(place > F.col("first")).select("order", "key", "start", "width") for df in (light, of_heavy)]
    return both[0].unionByName(both[1])


def remove_repeats(docs: DataFrame, window: int = WINDOW_LINES, long_words: int = LONG_LINE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n_lines, n_removed, kept_text`` behind its columns.

    A line goes if it lies in a run of ``window`` lines, or is a line of ``long_words`` words or more, that also occurs
    earlier: in a document of smaller doc_id or before in the same one. Kept lines are joined by line feeds; where
    nothing goes the text stays as it is, null too. Null and empty texts have no lines. Rows equal in id and text are one
    document and treated alike; null ids come last; among different texts with one id the order is a hash of the text.
    An empty table gives an empty one; columns named like the new ones are replaced.
    """
    late = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    base = docs.select(late.alias("order"), text_key(F.col("text")).alias("key"), "text")
    prints = staged(_selected(base, window, long_words), "lines")
    line = F.struct("order", "key", "line")
    shared = prints.groupBy("sign").agg(F.min(line).alias("a"), F.max(line).alias("b")).where(F.col("a") != F.col("b")).select("sign")
    live = staged(prints.join(shared, "sign", "left_semi").select("order", "key", F.inline("runs")), "lines")
    dropped(prints)
    later = _later(live)
    gone = later.groupBy("order", "key").agg(F.collect_set(F.struct("start", "width")).alias("runs"))
    numbers = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["width"] - 1))))
    gone = staged(gone.select(F.col("order").alias("__order"), F.col("key").alias("__key"), numbers.alias("__gone")), "lines")
    dropped(live)

    # the lines travel instead of the text, which they give back exactly
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], late.alias("__order"), text_key(F.col("text")).alias("__key"), F.when(F.col("text").isNotNull(), _lines(F.col("text"))).alias("__lines"))
    # the plan is the same at every size
    rows = rows.join(gone.hint("merge"), ["__order", "__key"], "left")
    n = F.coalesce(F.size("__lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), "__gone")
    kept = F.transform(left, lambda i: F.get("__lines", i))
    text = F.array_join("__lines", "\n")
    untouched = F.col("__gone").isNull()
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")],
        F.when(F.col("__lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(untouched, 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
        F.when(untouched, text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
