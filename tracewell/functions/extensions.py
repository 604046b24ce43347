"""Extension points: embedding providers, rerankers, recipes, views and table functions, as plain Python over DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_vector(text: str, dims: int) -> np.ndarray:
    """A unit vector made of SHA-256 blocks of the text: the same everywhere, without a model."""
    blocks = b"".join(hashlib.sha256(f"{k}:{text}".encode()).digest() for k in range(-(-dims // 32)))
    x = np.frombuffer(blocks[:dims], np.uint8).astype(np.float64) / 127.5 - 1
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


def embedded(text: Column, dims: int = 64) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashed_vector(t, dims).tolist())

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def scored(query: str, docs: DataFrame, scorer: Callable[[str, list[str]], list[float]], key: str = "handle", text: str = "text") -> DataFrame:
    """(key, second): a reranker's scores in batches; equal texts of a batch are scored once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p[text].fillna("")
            unique = texts.unique().tolist()
            yield pd.DataFrame({key: p[key], "second": texts.map(dict(zip(unique, scorer(query, unique), strict=True)))})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, second double")


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    words = set(query.lower().split())
    return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


@dataclass(frozen=True)
class Recipe:
    """A named query with typed inputs."""

    name: str
    sql: str
    inputs: dict[str, type] = field(default_factory=dict)

    def run(self, spark: SparkSession, frames: dict[str, DataFrame], **given) -> DataFrame:
        if missing := set(self.inputs) - set(given):
            raise ValueError(f"{self.name} needs {sorted(missing)}")
        if unknown := set(given) - set(self.inputs):
            raise ValueError(f"{self.name} has no input {sorted(unknown)}")
        return spark.sql(self.sql, args={k: self.inputs[k](v) for k, v in given.items()}, **frames)


@dataclass(frozen=True)
class View:
    """Source, filter, sort, groups and columns of a table view."""

    source: str
    columns: tuple[str, ...]
    where: str | None = None
    sort: tuple[tuple[str, bool], ...] = ()
    group: str | None = None
    first: int | None = None

    def run(self, frames: dict[str, DataFrame]) -> DataFrame:
        if self.source not in frames:
            raise ValueError(f"unknown source {self.source!r}")
        df = frames[self.source]
        if unknown := [c for c in (*self.columns, *(s for s, _ in self.sort)) if c not in df.columns]:
            raise ValueError(f"unknown columns {unknown}")
        if self.where:
            df = df.where(self.where)
        if self.group:
            return df.groupBy(self.group).agg(F.count(F.lit(1)).alias("n"), F.min(self.columns[0]).alias("first")).orderBy(F.desc("n"), self.group)
        df = df.orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in self.sort]) if self.sort else df
        return (df.limit(self.first) if self.first else df).select(*self.columns)


def register_functions(spark: SparkSession) -> None:
    """Make the table functions callable from SQL: split_lines(text) -> (line, text), scan_links(text) -> (target, alias)."""
    import re

    from pyspark.sql.functions import udtf

    @udtf(returnType="line int, text string")
    class SplitLines:
        def eval(self, text: str):
            for k, line in enumerate((text or "").split("\n"), 1):
                yield k, line

    @udtf(returnType="target string, alias string")
    class ScanLinks:
        def eval(self, text: str):
            for m in re.finditer(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]+))?\]\]", text or ""):
                yield m[1].strip(), (m[2] or "").strip()

    spark.udtf.register("split_lines", SplitLines)
    spark.udtf.register("scan_links", ScanLinks)
