"""Rebuilding conversations from message rows.

Rows are partitioned by conversation and sorted by instant and id; a finite-state automaton then reads each conversation. Its
state after a message is known from the last symbol alone, so every step needs only the message before, which a window over the
sorted partition gives without leaving the JVM. A conversation of more than HOT messages is cut into slabs at quantiles of its
order (instant, id, content), drawn from a bounded sample of it; each slab is sorted by itself and the slabs' ends are chained, so
no task sorts an unbounded conversation, whatever its messages' times.

Defined cases: a null session_id belongs to no conversation; rows with one id are one message (of unlike ones the smallest
holds), rows without an id are one message if they are alike; a null content is not visible; a message with an unknown role or
an unreadable time breaks its conversation unless its content is not visible; a conversation without turns is 'empty'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import written

#: More messages than these make a conversation hot.
HOT = 200_000
#: Slabs of a hot conversation, and rows of it that are drawn for each border.
SLABS, DRAWN = 256, 16
#: Hot conversations' slab borders are broadcast up to so many conversations (some 15 KB each), joined by shuffle beyond.
BROADCAST_HOT = 1_000

# Role names in use.
PERSON = ["user", "human", "person"]
ASSISTANT = ["assistant", "ai", "bot", "model"]
NO_TURN = ["system", "developer", "tool", "function"]

#: The automaton: (state, symbol) -> state. Symbols: u person, a assistant, r the same speaker and content again, x anything
#: else. States: S start, U person spoke, A assistant spoke. What is not listed rejects; A accepts.
AUTOMATON = {("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U", ("U", "r"): "U", ("A", "r"): "A"}

_UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def instants(rows: DataFrame, text: str) -> DataFrame:
    """rows with s and ns, the seconds and nanoseconds of a written time, null if it can't be read: ISO dates with T or a blank, up to
    nine digits of a second, a zone or none (UTC), or epoch seconds, milli-, micro- or nanoseconds. The time is taken apart once."""
    iso = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)? ?(Z|UTC|GMT|[+-]\d{2}:?(?:\d{2})?)?)?$"
    rows = rows.withColumn("_t", F.upper(F.regexp_replace(text, f"^{_UNSEEN}+|{_UNSEEN}+$", "")))
    # What the pattern doesn't fit stays in one part.
    rows = rows.withColumn("_p", F.split(F.regexp_replace(F.translate("_t", "|", "?"), iso, "$1|$2|$3|$4|$5|$6"), r"\|"))
    part = lambda k: F.get("_p", F.lit(k - 1))
    number = lambda c: F.when(c != "", c.try_cast("long")).otherwise(F.lit(0).cast("long"))
    day, zone = F.unix_date(part(1).try_cast("date")), F.translate(part(6), ":", "")
    hour, minute, second = number(part(2)), number(part(3)), number(part(4))
    shift = (number(F.substring(zone, 2, 2)) * 3600 + number(F.substring(zone, 4, 2)) * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when(F.substring(zone, 1, 1).isin("+", "-"), shift).otherwise(F.lit(0))
    fine = (F.size("_p") == 6) & (hour < 24) & (minute < 60) & (second < 61)
    seconds = F.when(fine, day.cast("long") * 86400 + hour * 3600 + minute * 60 + second - shift)
    value, size = F.when(F.size("_p") == 1, F.col("_t").try_cast("long")), F.length("_t")
    scale = F.when(size <= 11, F.lit(1)).when(size <= 14, F.lit(1000)).when(size <= 17, F.lit(1_000_000)).otherwise(F.lit(1_000_000_000)).cast("long")
    epoch = (size >= 9) & (size <= 19) & (F.translate("_t", "0123456789", "") == "")
    rows = rows.select("*", seconds.alias("_s"), number(F.rpad(part(5), 9, "0")).alias("_ns"), F.when(epoch, value).alias("_v"), scale.alias("_k"))
    rest = F.pmod(F.col("_v"), F.col("_k"))
    whole = F.when(F.col("_v").isNotNull(), ((F.col("_v") - rest) / F.col("_k")).cast("long")).otherwise(F.col("_s"))
    nanos = F.when(F.col("_v").isNotNull(), (rest * (F.lit(1_000_000_000).cast("long") / F.col("_k")).cast("long"))).when(F.col("_s").isNotNull(), F.col("_ns"))
    return rows.withColumn("s", whole).withColumn("ns", nanos).drop("_t", "_p", "_s", "_ns", "_v", "_k")


def messages(rows: DataFrame, content: bool = True) -> DataFrame:
    """One row per message that is a turn or breaks its conversation: (session_id, id, symbol, digest, s, ns[, content])."""
    cols = ["session_id", "role", "content", "created_at"]
    apart = F.when(F.col("id").isNull(), F.xxhash64(*cols))
    one = rows.where(F.col("session_id").isNotNull()).select("id", *cols, apart.alias("apart")).groupBy("id", "apart").agg(F.min(F.struct(*cols)).alias("m"))
    one = one.select("id", "m.*")
    role = F.lower(F.regexp_replace("role", f"^{_UNSEEN}+|{_UNSEEN}+$", ""))
    bare = F.regexp_replace("content", f"^{_UNSEEN}+|{_UNSEEN}+$", "")
    one = one.withColumn("_role", role).withColumn("_bare", bare)
    turns = one.where((F.coalesce(F.col("_bare"), F.lit("")) != "") & ~F.coalesce(F.col("_role").isin(NO_TURN), F.lit(False)))
    symbol = F.when(F.col("_role").isin(PERSON), "u").when(F.col("_role").isin(ASSISTANT), "a").otherwise("x")
    turns = turns.select("session_id", "id", symbol.alias("symbol"), F.sha2("_bare", 256).alias("digest"), "created_at", *["content"] * content)
    turns = instants(turns, "created_at").drop("created_at")
    return turns.withColumn("symbol", F.when(F.col("s").isNull(), "x").otherwise(F.col("symbol")))


def _place():
    """The order of a conversation as a value without nulls."""
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias(c)
    return F.struct(known("s"), known("ns"), known("id"), F.col("digest"))


def _slabbed(rows: DataFrame, hot_over: int) -> tuple[DataFrame, bool]:
    hot = written(rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_over)).df
    n = hot.count()
    if not n:
        return rows.withColumn("slab", F.lit(0)), False
    small = F.broadcast if n <= BROADCAST_HOT else lambda x: x
    share = F.least(F.lit(1.0), F.lit(float(SLABS * DRAWN)) / F.col("n")) * 1_000_000
    drawn = rows.join(small(hot), "session_id").where(F.pmod(F.xxhash64("id", "digest"), F.lit(1_000_000)) < share)
    sample = drawn.groupBy("session_id").agg(F.array_sort(F.collect_list(_place())).alias("p"))
    step = F.greatest(F.floor(F.size("p") / SLABS).cast("int"), F.lit(1))
    borders = sample.select("session_id", F.filter("p", lambda x, i: (i > 0) & (i % step == 0)).alias("borders"))
    borders = written(borders).df
    joined = rows.join(small(borders), "session_id", "left")
    slab = F.coalesce(F.size(F.filter("borders", lambda b: b < _place())), F.lit(0))
    return joined.withColumn("slab", F.when(F.col("borders").isNull(), 0).otherwise(slab)).drop("borders"), True


def turns(rows: DataFrame, hot_over: int = HOT, content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(turns, verdicts): every turn (session_id, turn_no, id, speaker, s, ns[, content]) and (session_id, reason) of all
    conversations with messages that count; the reason is null for those kept."""
    rows = written(messages(rows, content)).df
    carried = ["content"] * content
    rows, split = _slabbed(rows, hot_over)
    order = [F.col("s").asc_nulls_first(), F.col("ns").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")]
    inside = Window.partitionBy("session_id", "slab").orderBy(*order)
    now = F.struct("symbol", "digest")
    rows = rows.withColumn("before", F.lag(now).over(inside)).withColumn("n", F.row_number().over(inside))
    if split:
        rows = written(rows).df
        ends = rows.groupBy("session_id", "slab").agg(F.max_by(now, "n").alias("last"))
        ends = ends.withColumn("carried", F.lag("last").over(Window.partitionBy("session_id").orderBy("slab"))).drop("last")
        firsts = rows.where(F.col("n") == 1).drop("before").join(ends, ["session_id", "slab"]).withColumnRenamed("carried", "before")
        rows = rows.where(F.col("n") > 1).unionByName(firsts)
    again = (F.col("before.symbol") == F.col("symbol")) & (F.col("before.digest") == F.col("digest")) & (F.col("symbol") != "x")
    state = F.coalesce(F.translate(F.col("before.symbol"), "uax", "UAX"), F.lit("S"))
    table = F.create_map(*[F.lit(x) for (a, b), c in AUTOMATON.items() for x in (a + b, c)])
    step = F.try_element_at(table, F.concat(state, F.when(F.coalesce(again, F.lit(False)), "r").otherwise(F.col("symbol"))))
    read = written(rows.select("session_id", "slab", "n", "id", "symbol", *carried, "s", "ns", state.alias("state"), step.alias("next"), F.coalesce(again, F.lit(False)).alias("again"))).df
    ends = F.max_by("next", F.struct("slab", "n"))
    verdict = read.groupBy("session_id").agg(F.min(F.col("next").isNotNull()).alias("runs"), F.min(F.col("symbol") != "x").alias("named"), ends.alias("end"))
    reason = F.when(~F.col("named"), "unreadable").when(~F.col("runs"), "broken").when(F.col("end") != "A", "no reply")
    verdicts = verdict.select("session_id", reason.alias("reason"))
    fresh = read.where(~F.col("again"))
    count = F.row_number().over(Window.partitionBy("session_id", "slab").orderBy("n")).cast("long")
    if not split:
        numbered = fresh.withColumn("turn_no", count)
    else:
        sizes = fresh.groupBy("session_id", "slab").agg(F.count(F.lit(1)).alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("session_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("session_id", "slab", before.alias("past"))
        numbered = fresh.withColumn("local", count).join(sizes, ["session_id", "slab"]).withColumn("turn_no", F.col("local") + F.col("past"))
    speaker = F.when(F.col("symbol") == "u", "user").when(F.col("symbol") == "a", "assistant")
    return numbered.select("session_id", "turn_no", "id", speaker.alias("speaker"), *carried, "s", "ns"), verdicts


def verdicts(rows: DataFrame, hot_over: int = HOT) -> DataFrame:
    """(session_id, kept, reason) of all sessions."""
    found = turns(rows, hot_over, False)[1].withColumn("turns", F.lit(True))
    reason = F.when(F.col("turns").isNull(), "empty").otherwise(F.col("reason"))
    every = rows.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    return every.join(found, "session_id", "left").select("session_id", reason.isNull().alias("kept"), reason.alias("reason"))


def conversations(rows: DataFrame, hot_over: int = HOT, content: bool = True) -> DataFrame:
    """The turns of the conversations that are kept."""
    every, found = turns(rows, hot_over, content)
    return every.join(found.where("reason is null").select("session_id"), "session_id", "left_semi")
