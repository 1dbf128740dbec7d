"""Named queries over the test tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import agent_queries, fixtures, rule_queries, views
from .functions import names, strict_json
from .functions.cost import event_cost
from .functions.prices import flatten_prices, price_keys, small, with_prices
from .functions.times import day_in_zone, in_days, last_days
from .operators import checks, dedupe, incremental, registry, scans, simplify, stats, turns
from .plans.ingest import ingest_sessions
from .sources import lines
from .sources.scratch import scratch_folder
from .sources.warehouse import Warehouse, usage_events
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SINCE, UNTIL, TODAY = date(2024, 1, 5), date(2024, 1, 20), date(2024, 1, 25)
ZONE = "America/New_York"
#: Events of one log file.
LOG_EVENTS = 5_000


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(f: Query) -> Query:
    """Register a query; dates come out as ISO text, whatever reads them."""
    QUERIES[f.__name__] = lambda spark, sf_dir: _dates_as_text(f(spark, sf_dir))
    return f


def _priced(spark: SparkSession, sf_dir: str, agent: str = "opencode") -> DataFrame:
    return stats.priced_events(views.usage(spark, sf_dir), views.prices(spark), agent, zone="UTC")


@query
def daily_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_report_order(stats.usage_by(_priced(spark, sf_dir, "claude"), "day", "model_code"))


@query
def daily_usage_by_provider_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_report_order(stats.usage_by(_priced(spark, sf_dir), "day", "provider_code", "model_code"))


@query
def overall_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_report_order(stats.usage_by(_priced(spark, sf_dir), "provider_code", "model_code"))


@query
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_report_order(stats.usage_by(_priced(spark, sf_dir), "day"))


@query
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_by(_priced(spark, sf_dir)).withColumn("total_tokens", stats.total_tokens())


@query
def usage_report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_report(_priced(spark, sf_dir))


def _event_cost(agent: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = views.usage(spark, sf_dir).withColumn("model_code", F.coalesce("model_code", F.lit(stats.UNKNOWN)))
        return with_prices(u, views.prices(spark), agent).select("event_id", event_cost(agent).alias("cost"))

    return run


for _agent in ("claude", "codex", "opencode", "pi", "gemini"):
    QUERIES[f"event_cost_{_agent}"] = _event_cost(_agent)


def _with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider and model names with every kind of suffix, from events."""
    u = views.usage(spark, sf_dir)
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", ":free", "-free", ":free-free", ":beta:x", "-free:x")]), (F.col("event_id") % 6 + 1).cast("int"))
    base = F.element_at(F.array(*[F.lit(x) for x in ("gpt-5", "glm-4.7", "minimax-m2.1", "grok-code", "qwen/qwen3")]), (F.col("event_id") % 5 + 1).cast("int"))
    return u.select("event_id", "provider_code", F.concat(base, tail).alias("model_code"))


@query
def price_key_rules_opencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_names(spark, sf_dir).select("event_id", price_keys("opencode")[0].alias("price_key"))


@query
def price_key_rules_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_names(spark, sf_dir).select("event_id", price_keys("pi")[0].alias("price_key"))


@query
def strip_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_names(spark, sf_dir).groupBy(names.strip_free(F.col("model_code")).alias("model")).agg(F.count("*").alias("n"))


@query
def strip_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_names(spark, sf_dir).groupBy(names.strip_suffixes(F.col("model_code")).alias("model")).agg(F.count("*").alias("n"))


@query
def price_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested price documents, one per part, flattened."""
    p = table(spark, sf_dir, "part")
    cost = F.struct(F.col("p_retailprice").alias("input"), (F.col("p_size") * 2).alias("output"))
    model = F.map_from_arrays(F.array(F.concat(F.lit("m"), F.col("p_partkey").cast("string"))), F.array(F.struct(cost.alias("cost"), F.struct((F.col("p_size") * 1000).alias("context")).alias("limit"))))
    doc = F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(F.struct(F.lower("p_brand").alias("id"), model.alias("models")))))
    return flatten_prices(p.select(doc.alias("value"))).select("price_key", "input", "output", "cache_read", "context_limit")


@query
def day_bucket_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.usage(spark, sf_dir)
    return u.groupBy(day_in_zone(u, "event_timestamp", ZONE).alias("day")).agg(F.count("*").alias("n"))


@query
def since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = in_days(views.usage(spark, sf_dir), "event_timestamp", ZONE, SINCE, UNTIL)
    return u.groupBy(day_in_zone(u, "event_timestamp", ZONE).alias("day")).agg(F.count("*").alias("n"))


@query
def last_7_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = last_days(views.usage(spark, sf_dir), "event_timestamp", "UTC", TODAY)
    return u.groupBy(day_in_zone(u, "event_timestamp", "UTC").alias("day")).agg(F.count("*").alias("n"))


@query
def cwd_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions, market segments as working directories."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.concat(F.lit("/work/"), F.lower("c_mktsegment")).alias("cwd"))
    events = views.usage(spark, sf_dir).withColumn("session_id", F.col("user_id"))
    kept = stats.in_directory(events, sessions, "/work/building")
    return kept.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query
def three_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and nations as messages, sessions and projects."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(small(nation), customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("messages"), F.countDistinct("c_custkey").alias("sessions"))


@query
def dedupe_final_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = dedupe.fold_final(views.partial_final(spark, sf_dir), ["message_id"], "line_number", F.col("output_tokens"), F.col("stop_reason").isNotNull())
    return folded.select("message_id", "line_number", "output_tokens", "stop_reason", "duplicates")


@query
def dedupe_first_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedupe.first_per_cumulative(views.cumulative(spark, sf_dir), ["user_id"], "total_tokens", "event_id", F.col("last_tokens"))
    return first.select("user_id", "event_id", "total_tokens", "repeats", "conflict")


@query
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedupe.first_per_cumulative(views.cumulative(spark, sf_dir), ["user_id"], "total_tokens", "event_id")
    return checks.not_rising(first, ["user_id"], "event_id", "total_tokens").select("user_id", "event_id", "total_tokens", "before")


@query
def delta_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedupe.first_per_cumulative(views.cumulative(spark, sf_dir), ["user_id"], "total_tokens", "event_id")
    checked = dedupe.order_checks(first, ["user_id"], "event_id", "total_tokens", [(F.col("total_tokens"), F.col("last_tokens"))])
    return checked.filter("bad_delta").select("user_id", "event_id", "falls")


@query
def asof_model_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.attributed(views.turns(spark, sf_dir), ["user_id"], "event_id", F.col("is_turn"), F.col("model"), "current_model")
    return rows.filter(~F.col("is_turn")).select("user_id", "event_id", "current_model")


@query
def checkpoint_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    cp = incremental.checkpoints(views.usage(spark, sf_dir), ["session_id"], ["event_timestamp", "message_id"])
    return cp.select("session_id", F.date_format("cp.event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "cp.message_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All usage with a nullable agent, and the part of it that an earlier run has stored."""
    u = views.usage(spark, sf_dir).withColumn("agent_id", F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("a"), (F.col("user_id") % 2).cast("string"))))
    return u, u.filter((F.col("event_id") % 10 < 6) & (F.col("user_id") % 5 != 0))


@query
def checkpoint_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, stored = _halves(spark, sf_dir)
    scope, key = ["session_id", "agent_id"], ["event_id"]
    kept = incremental.after_checkpoint(u, incremental.checkpoints(stored, scope, key), scope, key, inclusive=True)
    return kept.select("session_id", "agent_id", "event_id")


@query
def tail_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, stored = _halves(spark, sf_dir)
    kept = incremental.after_checkpoint(u, incremental.checkpoints(stored, ["session_id"], ["event_timestamp", "event_id"]), ["session_id"], ["event_timestamp", "event_id"], inclusive=True)
    return kept.select("session_id", "event_id")


@query
def tail_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, stored = _halves(spark, sf_dir)
    stored = stored.filter(F.col("event_id") % 1000 < 500)
    kept = incremental.after_checkpoint(u, incremental.checkpoints(stored, [], ["event_timestamp", "event_id"]), [], ["event_timestamp", "event_id"], inclusive=False)
    return kept.select("session_id", "event_id")


@query
def file_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, customers as sessions."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file_path"))
    return incremental.file_rounds(files, ["session_id"])


@query
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: size is the order's price in cents, time its date; some have changed since."""
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("file_size"), F.col("o_orderdate").alias("file_mtime"))
    prior = now.filter("file_path % 4 <> 0").withColumn("file_size", F.when(F.col("file_path") % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")))
    return incremental.changed_files(now, prior).select("file_path", "file_size")


@query
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    incoming = o.filter("o_orderkey % 3 <> 0").unionByName(o.filter("o_orderkey % 5 = 0").withColumn("o_custkey", -F.col("o_custkey")))
    return incremental.insert_ignore(o.filter("o_orderkey % 2 = 0"), incoming, ["o_orderkey"], [F.desc("o_custkey")])


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit("first").alias("ingested_at"))
    incoming = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("second").alias("ingested_at"))
    return incremental.upsert(o.filter("o_orderkey % 2 = 0"), incoming, ["o_orderkey"], [F.desc("o_custkey")], keep=("ingested_at",))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0")
    path = F.concat(F.lit("/logs/"), F.when(F.col("c_custkey") % 6 == 1, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey")).cast("string"))
    return c.select(F.col("c_custkey").alias("project_id"), path.alias("path"), (F.col("c_custkey") % 5 != 0).alias("active"))


@query
def registry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    shown = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey"))
    found = c.select(F.col("c_custkey").alias("project_id"), F.concat(F.lit("/logs/"), shown.cast("string")).alias("path"), (F.col("c_custkey") % 13 == 0).alias("old_path_valid"))
    return registry.reconcile(found, _registry(spark, sf_dir))


@query
def registry_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id")).filter("project_id % 2 = 1")
    return registry.deactivate(_registry(spark, sf_dir), ids).select("project_id", "active", "deactivated")


@query
def registry_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "customer").select(F.concat(F.lit("/logs/"), F.col("c_custkey").cast("string")).alias("path"))
    return registry.missing(_registry(spark, sf_dir), listing).select("project_id", "path")


@query
def source_max_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gate = incremental.source_is_newer(e.agg(F.max("event_id").alias("source_max")), e.filter("event_id % 2 = 0").agg(F.max("event_id").alias("cp")))
    return gate


@query
def active_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") != "F").alias("active"))
    return registry.collisions(sources)


@query
def infile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.segments(views.turns(spark, sf_dir), ["user_id"], "event_id", F.col("is_turn"))


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.boundaries(_segmented(spark, sf_dir), ["user_id"], "event_id", F.col("is_turn"), "total_tokens")


@query
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.per_turn(_segmented(spark, sf_dir), ["user_id"], "event_id", F.col("is_turn"), "total_tokens")


@query
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir)


@query
def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.metric_summary(turn_segments(spark, sf_dir).filter("segment > 0"), "token_rows")


@query
def topk_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.top_frequencies(turn_segments(spark, sf_dir).filter("segment > 0"), "token_rows", 5, ["user_id", "segment"])


@query
def topk_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.top_frequencies(_boundaries(spark, sf_dir), "first_delta", 8, ["user_id", "segment"])


@query
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.match_rates(_boundaries(spark, sf_dir))


@query
def boundary_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.mismatches(_boundaries(spark, sf_dir), ["user_id"], 10).select("user_id", "turn_line", "previous_total", "first_total")


@query
def session_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First purchase of a user names the session of all rows of that user (JOIN-10), with distinct ids counted (AGG-21)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    named = turns.one_id_per_file(e, ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string"))))
    return named.groupBy("session_id").agg(F.count("*").alias("n"))


@query
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_missing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_by(views.usage(spark, sf_dir), "model_code", "session_id")


@query
def dq_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.session_summary(views.usage(spark, sf_dir), "session_id", "output_tokens")


@query
def dq_null_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.null_counters(views.usage(spark, sf_dir), ["input_tokens", "output_tokens", "model_code"])


@query
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return checks.orphans(table(spark, sf_dir, "orders"), parents, "o_custkey").select("o_orderkey", "o_custkey")


@query
def dq_rows_and_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.rows_and_sessions(views.usage(spark, sf_dir))


@query
def dq_by_provider_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.by_provider_model(_priced(spark, sf_dir), "cost")


@query
def dq_not_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_rising(views.cumulative(spark, sf_dir), ["user_id"], "event_id", "total_tokens").select("user_id", "event_id", "total_tokens", "before")


@query
def dq_wrong_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.wrong_increment(views.cumulative(spark, sf_dir), ["user_id"], "event_id", "total_tokens", "last_tokens").select("user_id", "event_id", "total_tokens", "before")


@query
def dq_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.current_checkpoint(views.usage(spark, sf_dir), ["event_id", "message_id"])


def _odd_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with counters of every type, made from events."""
    k = views.k_of_props().cast("string")
    kinds = [k, F.concat(F.lit('"'), k, F.lit('"')), F.concat(k, F.lit(".5")), F.lit("true"), F.lit("null"), F.lit('"x"'), F.lit("{}")]
    value = F.element_at(F.array(*kinds), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"n":'), value, F.lit(',"s":"t"}')).alias("doc"))


@query
def json_strict_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, error = strict_json.required_whole(strict_json.parsed(F.col("doc")), "$.n", "n")
    maybe, wrong = strict_json.optional_whole(strict_json.parsed(F.col("doc")), "$.n", "n", 0)
    return _odd_json(spark, sf_dir).select("event_id", got.alias("n"), error.alias("error"), maybe.alias("maybe"), wrong.isNotNull().alias("wrong"), strict_json.text(strict_json.parsed(F.col("doc")), "$.s").alias("s"))


@query
def lenient_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_json(spark, sf_dir).select("event_id", strict_json.lenient_whole(strict_json.parsed(F.col("doc")), "$.n").alias("n"))


@query
def simplify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry records, simplified at levels 0 to 3."""
    records = simplify.telemetry_records(table(spark, sf_dir, "events"))
    out = None
    for level in range(4):
        part = simplify.simplified(records, level).select("event_id", F.lit(level).alias("level"), F.length("value").alias("size"), F.md5("value").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("distinct_records"), F.sum("size").alias("length"), F.min("digest").alias("least"), F.max("digest").alias("most"))


@query
def weekly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_week(stats.usage_by(_priced(spark, sf_dir), "day"), "sunday")


@query
def monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_month(stats.usage_by(_priced(spark, sf_dir), "day"))


@query
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.by_session(_priced(spark, sf_dir).withColumn("version", F.concat(F.lit("1."), (F.col("event_id") % 3).cast("string"))))
    return found.withColumn("last_activity", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss"))


@query
def cost_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _priced(spark, sf_dir).withColumn("reported", F.when(F.col("event_id") % 3 != 0, F.col("cost") + F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.0)))
    return priced.select("event_id", *[stats.chosen_cost(m, F.col("reported"), F.col("cost")).alias(m) for m in ("auto", "calculate", "display")])


@query
def cost_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _priced(spark, sf_dir).withColumn("reported", F.col("cost") + F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.0))
    return stats.cost_mismatches(priced, "reported").select("event_id", F.round("difference", 6).alias("difference"))


@query
def usage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of use and the gaps between them."""
    usage = views.usage(spark, sf_dir)
    named = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("block")
    blocks = stats.usage_blocks(usage, "user_id").groupBy("user_id", named("block_start")).agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"), F.lit(False).alias("is_gap"))
    none = F.lit(0).cast("long")
    return blocks.unionByName(stats.gap_blocks(usage, "user_id").select("user_id", named("gap_start"), none.alias("n"), none.alias("output_tokens"), F.lit(True).alias("is_gap")))


@query
def raw_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw telemetry log (indented objects, one after another), written and scanned again; every tenth object has a closing line of its own."""
    path = scratch_folder(spark, "telemetry")
    records = simplify.telemetry_records(table(spark, sf_dir, "events"))
    opened = F.regexp_replace(F.regexp_replace("value", "^\\{", "{\n  "), "\\}$", "\n}")
    inner = F.when(F.col("event_id") % 10 == 0, F.replace(opened, F.lit('"resource":1'), F.lit('"resource":{\n"k":1\n}'))).otherwise(opened)
    records.select(inner.alias("value")).write.text(path)
    v = F.try_parse_json("value")
    return lines.concatenated_objects(spark, [path]).groupBy(simplify.name_of(v).alias("name")).agg(F.count("*").alias("n"), F.sum(strict_json.whole(v, "$.attributes.input_token_count")).alias("input_tokens"))


@query
def jsonl_scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON-lines logs of each user, some lines broken: bad lines by user, and the first such line of all its logs.

    A user's events are cut into logs of LOG_EVENTS events, so one with most of all events is written by many tasks, and
    there are no more logs than users and LOG_EVENTS make, however a user's events lie among those of others.
    """
    path = scratch_folder(spark, "logs")
    e = scans.running_sum(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.lit(1), "nth")
    log = F.concat_ws("_", "user_id", F.floor((F.col("nth") - 1) / LOG_EVENTS).cast("string"))
    e = e.select(log.alias("log"), "event_id", F.when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 50 == 0), "{broken").otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    e.repartition(fixtures.log_tasks(spark), "log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    scanned = lines.json_lines(lines.lines(spark, [path], pattern="*.txt"))
    of_path = lambda name, n: F.regexp_extract("file_path", "log=([0-9]+)_([0-9]+)", n).cast("long").alias(name)
    logs = scanned.groupBy(of_path("user_id", 1), of_path("part", 2)).agg(F.count("*").alias("n"), F.count_if("malformed").alias("bad"), F.min(F.when(F.col("malformed"), F.col("line_number"))).alias("first_bad"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = logs.withColumn("first_bad", above + F.col("first_bad"))
    return placed.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("first_bad").alias("first_bad"))


@query
def claude_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events as session logs with partial and final lines, ingested; tokens per session from the warehouse."""
    logs, store = scratch_folder(spark, "claude-logs"), scratch_folder(spark, "claude-warehouse")
    fixtures.write_logs(fixtures.claude_lines(views.usage(spark, sf_dir).filter("model_code is not null")), logs, ["event_id", "n"])
    warehouse = Warehouse(spark, store)
    ingest_sessions(warehouse, "claude", [logs], pattern="*.txt")
    return usage_events(warehouse, "claude").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


for _query in [*agent_queries.QUERIES.values(), *rule_queries.QUERIES.values()]:
    query(_query)
