"""Typed scalar columns: parsing, type inference, edge weights, confidence, proximity, test paths and document classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edge kinds with weight and the count at which it is clamped (0: not).
EDGE_KINDS = {"wikilink": (1.0, 0), "coderef": (1.0, 0), "mentions": (1.0, 0), "calls": (0.25, 5), "type_ref": (0.15, 4), "member_ref": (0.12, 4), "imports": (0.10, 3), "tests": (0.08, 3)}


def edge_weight(kind: Column, count: Column) -> Column:
    kind = F.lower(F.trim(kind))
    out = F.lit(0.0)
    for name, (weight, clamp) in EDGE_KINDS.items():
        out = F.when(kind == name, F.lit(weight) * (F.least(count, F.lit(clamp)) if clamp else count)).otherwise(out)
    return out


def confidence(label: Column, score: Column) -> Column:
    """A score above 0 holds, up to 1; else inferred .7, ambiguous .2, anything else 1."""
    label = F.lower(F.trim(label))
    named = F.when(label == "inferred", 0.7).when(label == "ambiguous", 0.2).otherwise(1.0)
    return F.when((score > 0) & ~F.isnan(score) & (score != float("inf")), F.least(score, F.lit(1.0))).otherwise(named)


def surprise_factor(label: Column, score: Column) -> Column:
    return 1 + 2 * (1 - confidence(label, score))


def similarity_of_bm25(bm25: Column) -> Column:
    """Lower bm25 is better."""
    return 1 / (1 + F.exp(bm25 / 2))


BOOLS = {"true": ["1", "t", "true"], "false": ["0", "f", "false"]}


def typed(raw: Column, kind: str) -> Column:
    """The canonical text of a written scalar, null if it is none of the kind: string, id, url, bool, int, real, date, datetime."""
    t = F.trim(raw)
    if kind == "bool":
        return F.when(F.lower(t).isin(BOOLS["true"]), "true").when(F.lower(t).isin(BOOLS["false"]), "false")
    if kind == "int":
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint").cast("string"))
    if kind == "real":
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double").cast("string"))
    if kind == "date":
        return F.when(t.rlike(r"^\d{4}([-/])\d{2}\1\d{2}$"), F.date_format(F.translate(t, "/", "-").try_cast("date"), "yyyy-MM-dd"))
    if kind == "datetime":
        parts = r"^(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:\d{2})?$"
        p = lambda k: F.regexp_extract(t, parts, k)
        local = F.concat_ws(" ", F.concat_ws("-", p(1), p(2), p(3)), F.concat_ws(":", p(4), p(5), F.when(p(6) == "", "00").otherwise(p(6)))).try_cast("timestamp_ntz")
        off = F.when(p(8).rlike("^[+-]"), (F.substring(p(8), 2, 2).try_cast("int") * 60 + F.substring(p(8), 5, 2).try_cast("int")) * F.when(p(8).startswith("-"), -1).otherwise(1)).otherwise(0)
        moved = local - F.make_dt_interval(F.lit(0), F.lit(0), off)
        return F.when(t.rlike(parts), F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.rpad(p(7), 9, "0"), F.lit("Z")))
    if kind == "url":
        return F.when(t.rlike(r"^(?i:https?)://[^/\s?#]+"), t)
    return F.when(t != "", t) if kind == "id" else t


def inferred_type(raw: Column) -> Column:
    """What a written property value is."""
    t = F.trim(raw)
    return (
        F.when(F.lower(t).isin("true", "false"), "bool")
        .when(t.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(t.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "float")
        .when(t.rlike(r"^\[\[[^\[\]]+\]\]$"), "wikilink")
        .when(t.rlike(r"^(?i:https?)://[^\s]+$"), "url")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "datetime")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .otherwise("string")
    )


def proximity(path: Column, seeds: list[str]) -> Column:
    """0 to 4: how near a path is to the nearest of some seeds: the same, the same folder or inside, below the seed's folder, the same top."""
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise("")
    best = F.lit(0)
    for seed in seeds:
        home = seed.rsplit("/", 1)[0] if "/" in seed else ""
        steps, own = F.split(path, "/"), seed.split("/")
        shared = F.lit(0)
        for k in range(len(own), 0, -1):
            shared = F.when((shared == 0) & (F.slice(steps, 1, k) == F.array(*map(F.lit, own[:k]))), k).otherwise(shared)
        depth = len(home.split("/")) if home else 0
        near = F.when(path == seed, 4).when(folder(path) == home, 3).when(path.startswith(seed + "/") | F.startswith(F.lit(seed), F.concat(path, F.lit("/"))), 3)
        near = near.when(shared >= depth, 2).otherwise(0) if depth else near.when(shared >= 1, 1).otherwise(0)
        best = F.greatest(best, near)
    return F.when(path.isNull() | (path == ""), 0).otherwise(best)


def is_test_path(path: Column) -> Column:
    """By the conventions of Go, Python, TypeScript, C# and PHP."""
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(_test\.go|(^|/)test_[^/]*\.py|_test\.py|\.(test|spec)\.[jt]sx?|tests?\.cs|test\.php)$")


# Folders of tools and of templates whose notes are generated; files that speak for a whole repository.
TOOL_FOLDERS, TEMPLATE_FOLDERS = [".codex/", ".claude/", ".cursor/"], ["/templates/skills/"]
REPO_FILES = ["readme.md", "agents.md", "claude.md"]


def doc_class(path: Column, kind: Column, more_templates: list[str] = (), more_files: list[str] = ()) -> Column:
    """hub, spec, effort, analysis, reference, generated, repo_global, module or none, by where a note lies. An installation names its
    own template folders (/name/) and repository files besides."""
    p = F.lower(path)
    generated = F.lit(False)
    for folder in TOOL_FOLDERS:
        generated |= p.startswith(folder)
    for folder in [*TEMPLATE_FOLDERS, *more_templates]:
        generated |= F.contains(p, F.lit(folder))
    base = F.regexp_replace(p, r"^.*/", "")
    return F.when((F.coalesce(F.lower(F.trim(kind)), F.lit("")) != "note") | (F.trim(p) == ""), "none").otherwise(
        F.when(p.startswith("docs/hubs/"), "hub").when(p.startswith("docs/specs/"), "spec").when(p.startswith("docs/efforts/"), "effort")
        .when(p.startswith("docs/reference/analysis/"), "analysis").when(p.startswith("docs/reference/"), "reference")
        .when(generated, "generated").when(p.isin(*REPO_FILES, *more_files), "repo_global").when(base == "context.md", "module").otherwise("none")
    )
