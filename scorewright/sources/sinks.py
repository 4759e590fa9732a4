"""Writers: result tables, CSV exports, log retention."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_results(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per result table."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{root}/{name}")


def load_result(spark, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{root}/{name}")


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Overwrites only the partitions present in ``df`` when the mode is overwrite."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_partitions(spark, path: str, column: str, before: str) -> list[str]:
    """Deletes the partitions of ``column`` whose value, compared as text, lies below ``before``; returns their values.

    Dynamic overwrite never removes a partition that the new rows lack, so a retention run needs this for expired days
    and rewrites the day of the cut-off alone.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name == column and value < before:
            fs.delete(status.getPath(), True)
            gone.append(value)
    return sorted(gone)


# ---------------------------------------------------------------- row-level deletion

#: Folders of a deletion inside the table (readers skip names that start with an underscore), and its journal.
DELETION, JOURNAL = "_deletion-", "journal.json"


class _Folder:
    """The table's file system; paths are the texts that Hadoop prints, unescaped."""

    def __init__(self, spark, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def plain(self, uri: str) -> str:
        return self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(uri)).toString()

    def names(self, folder) -> list:
        return [s.getPath() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def write(self, path, text: str) -> None:
        """Written beside and renamed, so that a journal is whole or absent."""
        beside = self.path(path.toString() + ".part")
        out = self.fs.create(beside, True)
        out.write(text.encode())
        out.close()
        self.fs.rename(beside, path)

    def read(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def delete_rows(spark, path: str, condition: Column) -> int:
    """Deletes the rows of a Parquet table for which ``condition`` is true; returns their number.

    Copy on write by file: only files that hold such rows are read again and rewritten into their own partition folder,
    all others stay untouched; partitions left without files go. The new files are written first, then a journal of both
    lists is committed, then new files move in and old ones go. A run that dies before the journal changes nothing, one
    that dies later is finished by the next call or by ``finish_deletions``; in between a reader may see rows of rewritten
    files twice, never too few. Rows where the condition is null stay. One deletion at a time per table.
    """
    finish_deletions(spark, path)
    files = _Folder(spark, path)
    df = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    touched = df.select(F.col("_metadata.file_path").alias("file"), hit.alias("hit")).where("hit").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    if not touched:
        return 0
    uris = [r["file"] for r in touched]
    homes = {hashlib.md5(u.rpartition("/")[0].encode()).hexdigest(): files.plain(u).rpartition("/")[0] for u in uris}
    below = files.plain(uris[0])[len(files.fs.makeQualified(files.root).toString()):]
    keys = [unquote(part.partition("=")[0]) for part in below.split("/")[:-1] if "=" in part]
    work = f"{path}/{DELETION}{uuid4().hex}"
    old = [files.plain(u) for u in uris]
    rows = spark.read.schema(df.schema).option("basePath", path).parquet(*old).where(~hit)
    home = F.md5(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))
    rows.withColumn("__home", home).drop(*keys).write.partitionBy("__home").parquet(f"{work}/data")
    new = []
    for folder in files.names(files.path(f"{work}/data")):
        _, _, name = folder.getName().partition("=")
        new += [[f.toString(), f"{homes[name]}/{f.getName()}"] for f in files.names(folder) if name and f.getName().endswith(".parquet")]
    files.write(files.path(f"{work}/{JOURNAL}"), json.dumps({"old": old, "new": new}))
    finish_deletions(spark, path)
    return sum(r["n"] for r in touched)


def finish_deletions(spark, path: str) -> int:
    """Carries out the committed deletions that a run left unfinished and removes uncommitted ones; returns how many were finished."""
    files, done = _Folder(spark, path), 0
    top = files.fs.makeQualified(files.root)
    for work in [p for p in files.names(files.root) if p.getName().startswith(DELETION)]:
        journal = files.path(f"{work.toString()}/{JOURNAL}")
        if files.fs.exists(journal):
            plan = json.loads(files.read(journal))
            for source, goal in plan["new"]:
                if files.fs.exists(files.path(source)):
                    files.fs.rename(files.path(source), files.path(goal))
            for gone in map(files.path, plan["old"]):
                files.fs.delete(gone, False)
                folder = gone.getParent()
                while not folder.equals(top) and files.fs.exists(folder) and not [p for p in files.names(folder) if p.getName()[0] not in "_."]:
                    files.fs.delete(folder, True)
                    folder = folder.getParent()
            done += 1
        files.fs.delete(work, True)
    return done
