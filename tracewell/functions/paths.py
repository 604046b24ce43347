"""Path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.runtime import stripped


def canonical_path(path: Column) -> Column:
    """One spelling of a path: no surrounding blanks, forward slashes, no empty, '.' or resolvable '..' steps, no slash at
    the end. Letter case stays; a leading slash stays. Null stays null; a blank path becomes ''."""
    plain = F.regexp_replace(F.translate(stripped(path), "\\", "/"), "/+", "/")
    plain = F.regexp_replace(plain, r"(?:(?<=/)|^)(?:\./)+", "")
    plain = F.when(plain.isin(".", "/."), F.substring(plain, 1, F.length(plain) - 1)).otherwise(F.regexp_replace(plain, r"(?<=[^/])/\.?$", ""))
    steps = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda done, step: F.when(
            (step == "..") & (F.size(done) > 0) & ~F.coalesce(F.element_at(done, -1), F.lit("")).isin("..", ""),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(step))),
    )
    return F.when(F.contains(plain, F.lit("..")), F.array_join(steps, "/")).otherwise(plain)
