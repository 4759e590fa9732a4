"""Document fingerprints: Merkle trees over clauses, paragraphs and sections.

A text is cut into paragraphs at line feeds and these into clauses, the leaves. A section ends after a paragraph whose
hash ends in SECTION_BITS zero bits, so an edit shifts no section but its own. Each node hashes its children; equal
roots mean equal texts, and two trees are compared by walking down the branches that differ.

A fingerprint is text: root|section:leaves;leaves|section:..., a paragraph's leaves written one after another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import text_key

LEAF_HEX = 10
SECTION_BITS = 2
#: Text bytes in a range of ids; past MAX_RANGES ranges they grow instead, and are sorted with spilling.
RANGE_BYTES = 8_000_000
MAX_RANGES = 4096

_CLAUSE = re.compile(r"(?<=[.!?,;:])(?=\s)")


def fingerprint(text: str) -> str:
    """Tree of one text; equal texts have equal fingerprints, an empty text has a root alone."""
    sections: list[str] = []
    root = blake2b(digest_size=16)
    paragraphs: list[str] = []
    section = blake2b(digest_size=8)

    def end() -> None:
        nonlocal section
        name = section.hexdigest()
        root.update(name.encode())
        sections.append(f"{name}:{';'.join(paragraphs)}")
        paragraphs.clear()
        section = blake2b(digest_size=8)

    for line in text.split("\n") if text else ():
        leaves = [xxhash.xxh3_128_hexdigest(c) for c in _CLAUSE.split(line)]
        node = blake2b("".join(leaves).encode(), digest_size=16).digest()
        section.update(node)
        paragraphs.append("".join([x[:LEAF_HEX] for x in leaves]))
        if node[-1] & (2**SECTION_BITS - 1) == 0:
            end()
    if paragraphs:
        end()
    return "|".join([root.hexdigest(), *sections])


def _leaves(section: str) -> list[str]:
    return [p[i : i + LEAF_HEX] for p in section.partition(":")[2].split(";") for i in range(0, len(p), LEAF_HEX)]


def likeness(a: str, b: str) -> float:
    """Shared leaves of two fingerprints, 0 to 1; leaves are looked at only in sections that differ."""
    ra, *sa = a.split("|")
    rb, *sb = b.split("|")
    if ra == rb:
        return 1.0
    ca, cb = Counter(sa), Counter(sb)
    same = ca & cb
    whole = sum(n * len(_leaves(s)) for s, n in same.items())
    la = Counter(x for s, n in (ca - same).items() for x in _leaves(s) * n)
    lb = Counter(x for s, n in (cb - same).items() for x in _leaves(s) * n)
    size = 2 * whole + sum(la.values()) + sum(lb.values())
    return (2 * whole + 2 * sum((la & lb).values())) / size if size else 0.0


def differences(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where ``a`` has leaves that ``b`` lacks: (section, paragraph, clause), counted from 0."""
    ra, *sa = a.split("|")
    rb, *sb = b.split("|")
    if ra == rb:
        return []
    shared = set(sb)
    known = Counter(x for s in sb for x in _leaves(s))
    out = []
    for i, s in enumerate(sa):
        if s in shared:
            continue
        for j, p in enumerate(s.partition(":")[2].split(";")):
            for k in range(0, len(p), LEAF_HEX):
                if known[p[k : k + LEAF_HEX]] > 0:
                    known[p[k : k + LEAF_HEX]] -= 1
                else:
                    out.append((i, j, k // LEAF_HEX))
    return out


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text) sorted into ranges ``__p`` of ids; each range ends with the first row of the following one, marked
    ``__borrowed``, the last with the first row of all."""
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("__key", text_key(F.col("text"))).withColumn("__v", F.col("doc_id").cast("double"))
    row = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "__key")
    stats = df.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(row).alias("first"), F.min("__v").alias("low")).first()
    n = max(1, min(MAX_RANGES, -(-(stats["bytes"] or 0) // range_bytes)))
    quantiles = df.agg(F.percentile_approx("__v", [i / n for i in range(1, n)], 100 * MAX_RANGES)).first()[0] if n > 1 else []
    cuts = sorted({x for x in quantiles or [] if stats["low"] is not None and x > stats["low"]})
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="__v", outputCol="__p", handleInvalid="keep").transform(df.withColumn("__v", F.coalesce("__v", F.lit(float("-inf")))))
        edges = spark.createDataFrame([(c, i) for i, c in enumerate(cuts)], "__v double, __edge int")  # at most MAX_RANGES rows
        df = cut.withColumn("__p", F.col("__p").cast("int")).join(F.broadcast(edges), "__v", "left")
    else:
        df = df.withColumns({"__p": F.lit(0), "__edge": F.lit(None).cast("int")})
    first = stats["first"]
    is_first = F.lit(False)
    if first is not None:
        is_first = F.col("doc_id").eqNullSafe(F.lit(first["doc_id"])) & (F.col("__key") == first["__key"])
    to = F.array(
        F.struct(F.col("__p").alias("p"), F.lit(False).alias("b")),
        F.when(F.col("__edge").isNotNull(), F.struct(F.col("__edge").alias("p"), F.lit(True).alias("b"))),
        F.when(is_first, F.struct(F.lit(len(cuts)).alias("p"), F.lit(True).alias("b"))),
    )
    df = df.select("doc_id", "text", "__key", F.explode(F.filter(to, lambda x: x.isNotNull())).alias("t"))
    df = df.select("doc_id", "text", "__key", F.col("t.p").alias("__p"), F.col("t.b").alias("__borrowed"))
    return df.repartition("__p").sortWithinPartitions("__p", "__borrowed", "doc_id", "__key")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next document's.

    The edited text has its last floor(n/2) characters replaced by the first as many of the next document in ascending
    doc_id order (after the last comes the first; a lone document follows itself). Null texts count as empty, null ids
    come first, rows with one id lie in order of a hash of their text. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None
        out: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for doc_id, text, p, borrowed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__p", "__borrowed")), strict=True):
                    own = fingerprint(text) if held is not None and p == at or not borrowed else ""
                    if held is not None and p == at:
                        out.append(_row(*held, text, own))
                    at = p
                    # after the first borrowed row of a range the rest are not needed
                    held = None if borrowed else (doc_id, text, own)
                yield _batch(out)
                out = []
        yield _batch(out)

    ordered = with_next(docs, range_bytes).select("doc_id", "text", "__p", "__borrowed")
    return ordered.mapInArrow(run, SCHEMA)


def _row(doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + following[: n // 2]
    changed = own if edited == text else fingerprint(edited)
    return doc_id, n, sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` of ``text`` behind its columns (replacing one of that name); null counts as empty."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept], "fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], prints], [*kept, "fingerprint"])

    return docs.mapInArrow(run, schema)
