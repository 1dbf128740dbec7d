"""Usage and cost reports (AGG-01..09, FLT-17..19, JOIN-01, ORD-01/02, EXT-01..06)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import event_cost, exact_sum, shown_input, shown_output
from ..functions.prices import with_prices
from ..functions.times import as_wall_clock, day_in_zone, in_days

UNKNOWN = "unknown"
#: Counters of a report row, in order.
COUNTERS = ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")


def priced_events(events: DataFrame, prices: DataFrame, agent: str, *, zone: str | None = "UTC", since: date | None = None, until: date | None = None, time_col: str = "event_timestamp") -> DataFrame:
    """Events of the days [since, until) with day, provider, model, report counters and cost.

    Cost is worked out per event, before any sum, because of the long-context tier.
    """
    kept = in_days(events, time_col, zone, since, until)
    unnamed = kept.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("provider_code", "model_code") if c in kept.columns})
    priced = with_prices(unnamed, prices, agent).withColumn("cost", event_cost(agent)).drop("price")
    return priced.withColumns({
        "day": day_in_zone(priced, time_col, zone),
        "shown_input": shown_input(agent),
        "shown_output": shown_output(agent),
    })


def sums() -> list[Column]:
    return [
        F.sum("shown_input").alias("input_tokens"), F.sum("cache_read_tokens").alias("cached_tokens"), F.sum("cache_write_tokens").alias("cache_write_tokens"),
        F.sum("shown_output").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count("*").alias("events"), exact_sum(F.col("cost")).alias("cost"),
    ]


def usage_by(priced: DataFrame, *keys: str) -> DataFrame:
    """Counters, events and cost by any of day, provider_code, model_code, session_id; none gives the grand total."""
    return priced.groupBy(*keys).agg(*sums()) if keys else priced.agg(*[c for c in sums()])


def usage_report(priced: DataFrame, keys: tuple[str, ...] = ("day", "provider_code", "model_code")) -> DataFrame:
    """The whole report in one table: per day and key, per key, per day, and in all, told apart by `level`.

    Events are summed to the finest level first; the roll-up expands only those rows.
    """
    finest = priced.groupBy(*keys).agg(*[s for s in sums()][:-1], F.sum(F.col("cost").cast("decimal(28,10)")).alias("exact"))
    day, *rest = keys
    sets = [list(keys), list(rest), [day], []]
    rolled = finest.groupingSets(sets, *keys).agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "events")], F.sum("exact").cast("double").alias("cost"), F.grouping_id().alias("g"))
    width = len(rest)
    level = F.when(F.col("g") == 0, "day_model").when(F.col("g") == 1 << width, "model").when(F.col("g") == (1 << width) - 1, "day").otherwise("total")
    return rolled.withColumn("level", level).drop("g")


def total_tokens() -> Column:
    """All counters of a report row (FN-21)."""
    out = F.lit(0).cast("long")
    for c in COUNTERS:
        out = out + F.col(c)
    return out


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(*[c for c in ("day", "provider_code", "model_code") if c in report.columns])


def in_directory(events: DataFrame, sessions: DataFrame, cwd: str) -> DataFrame:
    """Events whose session has exactly this working directory; sessions without a row vanish."""
    return events.join(sessions.filter(F.col("cwd") == cwd).select("session_id"), "session_id")


def week_start(day: Column, first: str = "monday") -> Column:
    """First day of the week that holds `day`."""
    offset = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"].index(first)
    return F.date_sub(day, (F.weekday(day) - offset + 7) % 7)


def by_week(daily: DataFrame, first: str = "monday") -> DataFrame:
    """Weekly roll-up of a report by day (EXT-02)."""
    return daily.withColumn("week", week_start(F.col("day"), first)).groupBy("week").agg(*_again())


def by_month(daily: DataFrame) -> DataFrame:
    return daily.withColumn("month", F.date_format("day", "yyyy-MM")).groupBy("month").agg(*_again())


def _again() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in (*COUNTERS, "events")], exact_sum(F.col("cost")).alias("cost")]


def by_session(priced: DataFrame, time_col: str = "event_timestamp") -> DataFrame:
    """Per session: usage, last activity, number of models and, where events have a version, the versions seen, in order (EXT-03)."""
    versions = [F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions")] if "version" in priced.columns else []
    return priced.groupBy("session_id").agg(*sums(), F.max(time_col).alias("last_activity"), F.countDistinct("model_code").alias("models"), *versions)


def chosen_cost(mode: str, reported: Column, calculated: Column) -> Column:
    """auto: reported if there, else calculated; calculate; display: reported, else 0 (EXT-01)."""
    return {"auto": F.coalesce(reported, calculated), "calculate": calculated, "display": F.coalesce(reported, F.lit(0.0))}[mode]


def cost_mismatches(priced: DataFrame, reported: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose reported cost differs from the calculated one by more than the tolerance (EXT-06)."""
    return priced.withColumn("difference", F.col(reported) - F.col("cost")).filter(F.abs("difference") > tolerance)


#: Hours of a stretch whose blocks are chained in one row.
STRETCH = 1024
_EPOCH = "1970-01-01 00:00:00"


def _by_hour(events: DataFrame, key: str, time_col: str) -> DataFrame:
    """(key, hour__, first__, last__): UTC hours with events, and the first and last time in them."""
    wall = events.select(key, as_wall_clock(events, time_col, "UTC").alias("wall__"))
    return wall.groupBy(key, _hour("wall__").alias("hour__")).agg(F.min("wall__").alias("first__"), F.max("wall__").alias("last__"))


def _hour(wall: str) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(wall)) / 3600).cast("long")


def block_hours(hours_of: DataFrame, key: str, hours: int = 5) -> DataFrame:
    """(key, hour__, start__): the first hour of the block that each hour is in, of distinct hours by key.

    A block starts at the first hour that is `hours` or more after the start before it, so a
    pause of that length starts one too. A stretch of hours is a function from the first hour
    at which a block may start in it (one of 0 to hours - 1, by what came before) to that of
    the next stretch. Those functions are worked out for all stretches side by side, then
    composed along each key, one small row per stretch of STRETCH hours, and each stretch is
    gone through once more from where it really begins.
    """
    if hours > STRETCH:
        raise ValueError(f"blocks of up to {STRETCH} hours")
    inside = F.col("hour__") - F.floor(F.col("hour__") / STRETCH) * STRETCH
    of_stretch = hours_of.groupBy(key, F.floor(F.col("hour__") / STRETCH).alias("stretch__")).agg(F.array_sort(F.collect_list(inside)).alias("h"))
    outcome = f"transform(sequence(0L, {hours - 1}L), c -> greatest(aggregate(h, c, (next, x) -> if(x >= next, x + {hours}L, next)) - {STRETCH}L, 0L))"
    of_stretch = of_stretch.withColumn("out__", F.expr(outcome))
    chain = of_stretch.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stretch__", "out__"))).alias("s"))
    begin = """aggregate(s, struct(cast(array() as array<struct<stretch__: bigint, begin__: bigint>>) as found, -2L as stretch, 0L as next),
      (a, x) -> transform(array(if(x.stretch__ = a.stretch + 1, a.next, 0L)), c -> struct(
        concat(a.found, array(struct(x.stretch__ as stretch__, c as begin__))) as found, x.stretch__ as stretch, element_at(x.out__, cast(c + 1 as int)) as next))[0],
      a -> a.found)"""
    begins = chain.select(key, F.inline(F.expr(begin)))
    walk = f"""aggregate(h, struct(cast(array() as array<struct<hour__: bigint, start__: bigint>>) as found, begin__ as next),
      (a, x) -> struct(concat(a.found, array(struct(x as hour__, if(x >= a.next, x, a.next - {hours}L) as start__))) as found, if(x >= a.next, x + {hours}L, a.next) as next),
      a -> a.found)"""
    walked = of_stretch.join(begins, [key, "stretch__"]).select(key, "stretch__", F.inline(F.expr(walk)))
    offset = F.col("stretch__") * STRETCH
    return walked.select(key, (offset + F.col("hour__")).alias("hour__"), (offset + F.col("start__")).alias("start__"))


def usage_blocks(events: DataFrame, key: str, hours: int = 5, time_col: str = "event_timestamp") -> DataFrame:
    """Blocks of use per key: a block starts at the UTC hour of its first event and takes later events
    until `hours` after its start or a pause of `hours` (EXT-04). Adds block_start (wall clock, UTC).

    Only distinct hours are chained; events find their block by key and hour, so those of one
    key are spread over many tasks.
    """
    starts = block_hours(_by_hour(events, key, time_col), key, hours)
    timed = events.withColumn("wall__", as_wall_clock(events, time_col, "UTC")).withColumn("hour__", _hour("wall__"))
    epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    return timed.join(starts, [key, "hour__"]).withColumn("block_start", F.timestamp_add("HOUR", F.col("start__"), epoch)).drop("wall__", "hour__", "start__")


def gap_blocks(events: DataFrame, key: str, hours: int = 5, time_col: str = "event_timestamp") -> DataFrame:
    """(key, gap_start, gap_end): pauses longer than a block, from `hours` after the last event to the next one (EXT-04).

    A pause spans hours, so the first and last event of each hour are all that is ordered by key.
    """
    before = F.lag("last__").over(Window.partitionBy(key).orderBy("hour__"))
    paused = _by_hour(events, key, time_col).withColumn("before__", before).filter(F.timestamp_diff("SECOND", F.col("before__"), F.col("first__")) > hours * 3600)
    return paused.select(key, F.timestamp_add("HOUR", F.lit(hours), F.col("before__")).alias("gap_start"), F.col("first__").alias("gap_end"))


def burn_rate(blocks: DataFrame, key: str, now: Column, hours: int = 5, time_col: str = "event_timestamp") -> DataFrame:
    """Per block: tokens, minutes of use, tokens a minute, whether it is active, and tokens projected to its end (EXT-05)."""
    wall = as_wall_clock(blocks, time_col, "UTC")
    per = blocks.withColumn("wall__", wall).groupBy(key, "block_start").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.min("wall__").alias("first"), F.max("wall__").alias("last"))
    minutes = F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / 60.0
    left = F.greatest(F.timestamp_diff("SECOND", now, F.col("block_start") + F.make_dt_interval(hours=F.lit(hours))) / 60.0, F.lit(0.0))
    active = (F.timestamp_diff("SECOND", F.col("last"), now) < hours * 3600) & (left > 0)
    rate = F.when(minutes > 0, F.col("tokens") / minutes)
    return per.select(key, "block_start", "tokens", minutes.alias("minutes"), rate.alias("tokens_per_minute"), active.alias("active"), F.when(active, F.col("tokens") + F.coalesce(rate, F.lit(0.0)) * left).alias("projected_tokens"))
