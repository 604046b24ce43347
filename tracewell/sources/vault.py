"""Sources and sinks: files on disk, snapshots of tables, and the difference between two snapshots.

A sink writes a whole new snapshot beside the old one and then moves the pointer, so readers never see half a write and a lost
executor only repeats tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T

# Languages by file ending.
LANGUAGES = {"go": "go", "ts": "ts", "tsx": "ts", "js": "js", "jsx": "js", "mjs": "js", "py": "py", "cs": "cs", "php": "php"}
COMMENT = r"(?m)(?:^|\s)(?://|#|\*|/\*)[^\n]*"


def note_files(spark: SparkSession, folder: str, exclude: list[str] = ()) -> DataFrame:
    """(path, text, mtime, size) of the Markdown files below a folder, without those whose path matches a regex."""
    return _files(spark, folder, "*.md", exclude)


def code_files(spark: SparkSession, folder: str, exclude: list[str] = ()) -> DataFrame:
    """(path, text, mtime, size, lang) of the code files below a folder, by ending."""
    rows = _files(spark, folder, "*.{" + ",".join(LANGUAGES) + "}", exclude)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return rows.withColumn("lang", F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending))


def _files(spark, folder, glob, exclude) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    rows = raw.select(inside.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    for e in exclude:
        rows = rows.where(~F.col("path").rlike(e))
    return rows


def discovered(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state) of what differs between two listings (path, hash): added, changed or removed. Equal rows drop out in the join."""
    a, b = now.groupBy("path").agg(F.max("hash").alias("h1")), before.groupBy("path").agg(F.max("hash").alias("h0"))
    state = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").where(~F.col("h1").eqNullSafe(F.col("h0"))).select("path", state.alias("state"))


def code_references(files: DataFrame) -> DataFrame:
    """(path, line, target) of links and @mentions in comments."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(COMMENT))
    comment = F.regexp_extract("text", r"(?:^|\s)((?://|#|\*|/\*).*)$", 1)
    links = F.regexp_extract_all(comment, F.lit(r"\[\[([^\[\]|#\n]+)"), 1)
    people = F.regexp_extract_all(comment, F.lit(r"(?:^|\s)@([a-z][a-z-]+)"), 1)
    return lines.select("path", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.array_distinct(F.concat(links, people))).alias("target"))


def by_prefix(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """A directory's rows; both conditions are pushed to the files."""
    return df.where((F.col(path) == prefix) | F.col(path).startswith(prefix + "/"))


#: Keys up to this many are sent to the table; more are joined as Spark sees fit.
SEND_KEYS = 50_000


def looked_up(df: DataFrame, keys: list, key: str) -> DataFrame:
    ids = df.sparkSession.createDataFrame([(k,) for k in keys], [key]) if keys else df.select(key).limit(0)
    return df.join(F.broadcast(ids) if len(keys) <= SEND_KEYS else ids, key, "left_semi")


def replaced(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in `new` replaced by the new ones."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def upserted(old: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(changed)


def save_snapshot(frames: dict[str, DataFrame], root: str, version: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Several tables as one unit: all written below root/version, then root/CURRENT names it."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        if cols := (partition_by or {}).get(name):
            w = w.partitionBy(*cols)
        w.parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")


def load_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")


def with_cache(texts: DataFrame, cache: DataFrame, model: str, dims: int, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts, new cache rows): texts (hash, text) whose (hash, model, dims) is not cached are embedded once each."""
    known = cache.where((F.col("model") == model) & (F.col("dims") == dims)).select("hash", "vector").dropDuplicates(["hash"])
    misses = texts.select("hash", "text").dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")
    fresh = embed(misses).select("hash", "vector", F.lit(model).alias("model"), F.lit(dims).alias("dims"))
    both = known.unionByName(fresh.select("hash", "vector"))
    return texts.join(both, "hash", "left"), fresh


def as_json(df: DataFrame) -> list[str]:
    """Rows as JSON texts, for small results."""
    return [json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.collect()]


def chunk_text(notes: DataFrame) -> DataFrame:
    return notes.select("path", T.body(F.col("text")).alias("text"))
