"""Rules that bind paths: globs and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: Column) -> Column:
    """The regex of a glob: ** any steps, * within a step, ? one character; all else literally."""
    plain = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    marked = F.regexp_replace(plain, r"\*\*/", "\u0001")
    marked = F.regexp_replace(marked, r"\*\*", "\u0002")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(marked, "\u0001", "(?:.*/)?"), "\u0002", ".*"), F.lit("$"))


def glob_join(paths: DataFrame, rules: DataFrame, path: str = "path", glob: str = "glob") -> DataFrame:
    """paths x rules whose glob matches. Rules with a fixed first step join on it; only the others meet all paths, and as rules are
    given by hand the smaller side of either join is theirs. A null path or glob matches nothing."""
    first = F.regexp_extract(glob, r"^([^*?\[/]+)/", 1)
    r = rules.withColumn("_re", glob_regex(F.col(glob))).withColumn("_first", F.when(first != "", first))
    p = paths.withColumn("_first", F.substring_index(path, "/", 1))
    fixed = p.join(r.where("_first is not null"), "_first").where(F.expr(f"{path} rlike _re"))
    free = p.drop("_first").join(r.where("_first is null").drop("_first"), F.expr(f"{path} rlike _re"))
    return fixed.drop("_first", "_re").unionByName(free.drop("_re"))


def under(path: Column, prefix: str) -> Column:
    """Equal to or below a directory; '*' is every path."""
    if prefix == "*":
        return path.isNotNull()
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")
