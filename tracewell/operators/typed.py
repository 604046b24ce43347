"""Typed records: filters, sorts, pagination and relations over field values in rows (EAV).

nodes: (node_id, type_name, note_path, start_byte, title, ...); values: (node_id, type_name, field_name, value_kind, value_norm,
value_num, target_node_id, ordinal, presence). presence 'null' marks an authored null; array and object values never match a
comparison. A filter becomes a semi-join on the field's rows; `neq` and `missing` are the anti-joins of `eq` and `exists`, so a node
whose list holds the value is no neq match and one without the field is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which operators a field kind allows.
ALLOWED = {
    "bool": {"eq", "exists"},
    **dict.fromkeys(("int", "real", "date", "datetime"), {"eq", "in", "exists", "gt", "gte", "lt", "lte"}),
    **dict.fromkeys(("string", "id", "url"), {"eq", "in", "exists", "neq", "contains", "missing"}),
    **dict.fromkeys(("enum", "link"), {"eq", "in", "exists"}),
}
NUMERIC = {"int", "real"}


@dataclass(frozen=True)
class Filter:
    name: str
    op: str
    values: tuple = ()
    kind: str = "string"


@dataclass(frozen=True)
class Sort:
    name: str
    desc: bool = False
    kind: str = "string"


@dataclass(frozen=True)
class Plan:
    """What to read: types (several for an interface), filters, sorts, and one page."""

    types: tuple[str, ...]
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    first: int = 20
    offset: int = 0
    path: str | None = None


@dataclass(frozen=True)
class Schema:
    """Fields by type, types by interface, the order of enum values."""

    fields: dict[str, dict[str, str]]
    interfaces: dict[str, tuple[str, ...]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def types_of(self, name: str) -> tuple[str, ...]:
        return self.interfaces.get(name, (name,))

    def check(self, plan: Plan) -> None:
        for t in plan.types:
            known = self.fields.get(t)
            if known is None:
                raise ValueError(f"unknown type {t!r}")
            for f in (*plan.filters, *plan.sorts):
                if f.name not in known:
                    raise ValueError(f"type {t!r} has no field {f.name!r}")
                if isinstance(f, Filter) and f.op not in ALLOWED[known[f.name]]:
                    raise ValueError(f"{known[f.name]} field {f.name!r} does not allow {f.op!r}")
                if isinstance(f, Sort) and known[f.name] == "bool":
                    raise ValueError(f"bool field {f.name!r} is not sortable")


def condition(f: Filter) -> Column:
    """On one row of the field."""
    if f.op in ("exists", "missing"):
        return (F.col("value_norm") != "") | (F.col("presence") == "value")
    plain = (F.col("presence") != "null") & ~F.col("value_kind").isin("array", "object")
    left = F.col("value_num") if f.kind in NUMERIC else F.col("target_node_id") if f.kind == "link" else F.col("value_norm")
    right = [F.lit(float(v)) if f.kind in NUMERIC else F.lit(v) for v in f.values]
    by_op = {"eq": lambda: left == right[0], "neq": lambda: left == right[0], "in": lambda: left.isin(list(f.values)), "contains": lambda: F.contains(left, right[0]),
             "gt": lambda: left > right[0], "gte": lambda: left >= right[0], "lt": lambda: left < right[0], "lte": lambda: left <= right[0]}
    return plain & by_op[f.op]()


def matching(nodes: DataFrame, values: DataFrame, plan: Plan) -> DataFrame:
    rows = nodes.where(F.col("type_name").isin(list(plan.types)))
    if plan.path is not None:
        rows = rows.where((F.col("note_path") == plan.path) | F.col("note_path").startswith(plan.path + "/"))
    for f in plan.filters:
        hits = values.where((F.col("field_name") == f.name.lower()) & F.col("type_name").isin(list(plan.types)) & F.coalesce(condition(f), F.lit(False))).select("node_id")
        rows = rows.join(hits, "node_id", "left_anti" if f.op in ("neq", "missing") else "left_semi")
    return rows


def page(nodes: DataFrame, values: DataFrame, plan: Plan) -> DataFrame:
    """One page in order: sort fields by the smallest of a node's values (the largest if descending), nulls last either way, then
    path, start and id."""
    rows = matching(nodes, values, plan)
    order = []
    for i, s in enumerate(plan.sorts):
        column = "value_num" if s.kind in NUMERIC else "value_norm"
        keyed = values.where((F.col("field_name") == s.name.lower()) & (F.col("presence") != "null")).groupBy("node_id").agg((F.max if s.desc else F.min)(column).alias(f"_s{i}"))
        rows = rows.join(keyed, "node_id", "left")
        order.append(F.col(f"_s{i}").desc_nulls_last() if s.desc else F.col(f"_s{i}").asc_nulls_last())
    stable = [F.col(c).asc_nulls_first() for c in ("note_path", "start_byte", "node_id")]
    out = rows.orderBy(*order, *stable)
    return (out.offset(plan.offset) if plan.offset else out).limit(plan.first).drop(*[f"_s{i}" for i in range(len(plan.sorts))])


def selected(rows: DataFrame, values: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with the fields asked for, in the order asked: alias -> (field, kind). A text field is its values in order, joined by
    commas; a number the smallest; a null or absent field is null. One pass over the values for all fields."""
    v = values.where(F.col("field_name").isin([f for f, _ in fields.values()]) & (F.col("presence") != "null"))
    of = []
    for alias, (field, kind) in fields.items():
        mine = F.col("field_name") == field
        if kind in NUMERIC:
            of.append(F.min(F.when(mine, F.col("value_num"))).alias(alias))
        else:
            of.append(F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(mine, F.col("value_norm")))), ","), F.lit("")).alias(alias))
    return rows.join(v.groupBy("node_id").agg(*of), "node_id", "left")


def explained(nodes: DataFrame, values: DataFrame, plan: Plan) -> str:
    """How a plan runs: Spark's own formatted plan."""
    return page(nodes, values, plan)._jdf.queryExecution().explainString(nodes.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def field_counts(values: DataFrame, name: str) -> DataFrame:
    v = values.where((F.col("field_name") == name) & (F.col("presence") != "null"))
    return v.groupBy("value_norm").agg(F.countDistinct("node_id").alias("nodes"))


def type_summaries(nodes: DataFrame, issues: DataFrame, preview: int = 3) -> DataFrame:
    """(type_name, nodes, issues, preview): counts, and the first titles by path."""
    place = F.row_number().over(Window.partitionBy("type_name").orderBy("note_path", "start_byte", "node_id"))
    n = nodes.join(issues.groupBy("node_id").agg(F.count(F.lit(1)).alias("i")), "node_id", "left").withColumn("place", place)
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= preview, F.struct("place", "title"))))
    return n.groupBy("type_name").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("i"), F.lit(0)).alias("issues"), F.array_join(F.transform(shown, lambda x: x["title"]), "; ").alias("preview"))


def relation_counts(sources: DataFrame, selections: list[DataFrame]) -> DataFrame:
    """Distinct targets per source over several selections (src, dst) at once."""
    both = selections[0]
    for s in selections[1:]:
        both = both.unionByName(s)
    n = both.groupBy("src").agg(F.countDistinct("dst").alias("n"))
    return sources.join(n, sources["node_id"] == n["src"], "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def resolved(names: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, path, rank, candidates): the note a written name means: by path, by path with .md, by file name, by title; the best kind
    that has candidates holds, and only one candidate of it resolves."""
    low = lambda c: F.lower(F.trim(c))
    base = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")
    forms = notes.select("path", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), low(c).alias("form")) for r, c in ((1, F.col("path")), (2, F.regexp_replace("path", r"\.md$", "")), (3, base), (4, F.coalesce("title", F.lit(""))))])).alias("f")).select("path", "f.*").where("form <> ''")
    met = names.select("name", low(F.col("name")).alias("form")).join(forms, "form").groupBy("name", "rank").agg(F.countDistinct("path").alias("candidates"), F.min("path").alias("path"))
    best = met.groupBy("name").agg(F.min(F.struct("rank", "candidates", "path")).alias("b")).select("name", "b.*")
    return names.join(best, "name", "left").select("name", F.when(F.col("candidates") == 1, F.col("path")).alias("path"), "rank", F.coalesce("candidates", F.lit(0)).alias("candidates"))
