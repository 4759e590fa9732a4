"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key scaled by its quality weight. Within a source the documents are taken in
key order: whole epochs first, then documents until what is left of the source's budget is used up. The last one gives
only the words that still fit, so a source meets its budget to the word.
The running sizes are summed in key buckets of about BUCKET_ROWS documents, bucket totals in groups of
GROUP buckets, group totals per source, so a source with most of the rows still runs in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import assign, small_side, staged, text_key, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
BUCKET_ROWS = 256
GROUP = 1024
#: Uniform numbers come from the first 52 bits of a digest.
UNIFORM_BITS = 52


def quality_weight(text: Column, size: Column) -> Column:
    """2 for texts of ordinary word length, 0.5 for others; half as much again if the text ends a sentence."""
    mean = F.try_divide(F.char_length(text).cast("double"), size.cast("double"))
    return F.when(mean.between(4, 14), 2.0).otherwise(0.5) * F.when(F.substring(text, -1, 1).isin(".", "!", "?"), 1.5).otherwise(1.0)


def _draw(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, UNIFORM_BITS // 4), 16, 10).cast("double") + 0.5) / float(2**UNIFORM_BITS)
    return -F.ln(u) / weight


def _row(doc_id: Column, th: Column) -> Column:
    """Order among equal draws: by id, null first, then by text key."""
    return F.struct(doc_id.isNotNull().alias("known"), doc_id.alias("id"), th.alias("th"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows) to the same with ``sid, weight, target``: one row per source.

    Sources in code point order, null last, get the weights in turn. A source's target is its share of all sizes, at most
    ``max_epochs`` times its own; what is cut off goes to the others by weight until all fit.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    t = t.withColumn("weight", F.element_at(cycle, (F.col("sid") - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    )
    t = t.withColumn("level", F.col("left") / F.col("open"))
    # the first source in order of cap per weight that its level does not overfill
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    return t.select("source", "source_size", "n_rows", "sid", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut_draw, cut_row, cut_words.

    ``epochs`` whole passes are taken, and once more each document before the cut (null: none), and cut_words of the
    document at the cut.
    Rows equal in id and text are drawn together. Documents without words weigh like any other and have size 0.
    """
    size = word_count(F.col("text"))
    slim = staged(
        docs.select("source", F.col("doc_id").alias("id"), text_key(F.col("text")).alias("th"), "text", size.alias("size"))
        .select("source", "id", "th", "size", _draw(F.col("id"), quality_weight(F.col("text"), F.col("size")), seed).alias("draw")),
        "mix",
    )
    slim = slim.withColumn("draw", F.coalesce("draw", F.lit(float("inf"))))
    sources = staged(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, max_epochs), "mix")
    sources = sources.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    few = small_side(sources.select(F.col("source").alias("s"), "sid", "n_rows", "rest"))
    items = slim.join(few, slim["source"].eqNullSafe(few["s"])).groupBy("sid", "draw", "id", "th", "n_rows", "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    items = items.withColumn("bucket", F.least(buckets - 1, F.floor(buckets * (1 - F.exp(-F.col("draw"))))))
    order = [F.asc("draw"), F.asc_nulls_first("id"), F.asc("th")]
    inside = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    totals = items.groupBy("sid", "bucket").agg(F.sum("size").alias("size")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    in_group = Window.partitionBy("sid", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("sid", "group").agg(F.sum("size").alias("size")).select("sid", "group", F.coalesce(F.sum("size").over(of_source), F.lit(0)).alias("g"))
    offsets = totals.withColumn("b", F.coalesce(F.sum("size").over(in_group), F.lit(0))).join(groups, ["sid", "group"]).select("sid", "bucket", (F.col("b") + F.col("g")).alias("offset"))

    before = F.col("inside") + F.col("offset")
    words = F.floor(F.least(F.col("size").cast("double"), F.round(F.col("rest") - before)) / F.col("rows"))
    chosen = items.join(offsets, ["sid", "bucket"]).where(before < F.col("rest"))
    cuts = chosen.groupBy("sid").agg(F.max(F.struct("draw", _row(F.col("id"), F.col("th")).alias("row"), words.alias("words"))).alias("cut"))
    return staged(
        sources.join(cuts, "sid", "left").select(
            "source", "source_size", "target", "epochs", F.col("cut.draw").alias("cut_draw"), F.col("cut.row").alias("cut_row"), F.col("cut.words").alias("cut_words")
        ),
        "mix",
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``size, source_size, target, copies, part, taken`` behind its columns.

    ``copies`` is how often the mix takes the whole row, ``part`` how many words of it once more, ``taken`` the words in
    all. Null text: size 0; null source is a source of its own; an empty table gives an empty one; columns of these names
    are replaced.
    """
    cuts = plan(docs, weights, max_epochs, seed)
    few = small_side(cuts.select(F.struct("*").alias("__plan"), F.col("source").alias("__source")))
    df = docs.join(few, docs["source"].eqNullSafe(few["__source"])).drop("__source")
    size = word_count(F.col("text"))
    df = df.withColumn("__size", size)
    draw = F.coalesce(_draw(F.col("doc_id"), quality_weight(F.col("text"), F.col("__size")), seed), F.lit(float("inf")))
    row = _row(F.col("doc_id"), text_key(F.col("text")))
    cut = F.col("__plan.cut_draw")
    at_cut = F.coalesce((draw == cut) & (row == F.col("__plan.cut_row")), F.lit(False))
    once = F.coalesce((draw < cut) | ((draw == cut) & (row < F.col("__plan.cut_row"))), F.lit(False))
    # a document that fits to its last word is taken whole
    whole = once | (at_cut & (F.col("__plan.cut_words") >= F.col("__size")))
    df = df.withColumn("__copies", F.col("__plan.epochs") + whole.cast("long"))
    df = df.withColumn("__part", F.when(at_cut & ~whole, F.col("__plan.cut_words")).otherwise(0).cast("long"))
    out = assign(
        df, size=F.col("__size"), source_size=F.col("__plan.source_size"), target=F.col("__plan.target"), copies=F.col("__copies"), part=F.col("__part"),
        taken=F.col("__copies") * F.col("__size") + F.col("__part"),
    )
    return out.drop("__plan", "__size", "__copies", "__part")


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself, of whole documents: each row as often as ``copies`` says, and once more if at least half of its
    words were wanted (``part``), so that a source misses its target by half a document at most; only ``columns`` are
    kept. Null and empty texts come as they are, as often as their source's epochs."""
    times = F.col("copies") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    rows = mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
