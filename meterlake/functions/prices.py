"""Price list: flattening, and joining prices to events (SRC-09, TAB-01/02, FN-27, JOIN-03/04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import names
from .strict_json import at, kind, number, text

#: Prices in USD per token, as columns of a price table next to price_key.
PRICES = ("input", "output", "cache_read", "cache_write", "input_200k", "output_200k", "cache_read_200k", "cache_write_200k")
#: Up to so many rows are broadcast; a longer list joins by shuffle.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """`df` with a broadcast hint if a count shows that it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def per_token(usd_per_million: Column) -> Column:
    return usd_per_million / F.lit(1_000_000.0)


def price_table(per_million: DataFrame) -> DataFrame:
    """(price_key, prices per token) of a table in USD per million; absent prices are null."""
    return per_million.select("price_key", *[(per_token(F.col(c)) if c in per_million.columns else F.lit(None).cast("double")).alias(c) for c in PRICES])


def load_price_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole price files, one row each."""
    return spark.read.text(path, wholetext=True)


def flatten_prices(raw: DataFrame, column: str = "value") -> DataFrame:
    """(price_key, prices per token, context_limit, output_limit) of price documents.

    Nested documents map provider -> {id, models: {model: {cost, limit}}} in USD per million;
    the key is `id/model`, or the map's key where id isn't text. A document in which no value
    has both id and models is flat already: its keys and per-token prices pass through. What
    is no object is skipped.
    """
    doc = F.try_parse_json(F.col(column))
    top = raw.select(F.monotonically_increasing_id().alias("doc"), F.from_json(F.when(kind(doc) == "OBJECT", F.to_json(doc)), "map<string,string>").alias("m"))
    entries = top.select("doc", F.explode("m").alias("key", "body")).select("doc", "key", F.try_parse_json("body").alias("v")).filter(kind(F.col("v")) == "OBJECT")
    v = F.col("v")
    is_nested = at(v, "$.id").isNotNull() & at(v, "$.models").isNotNull()
    nested_docs = entries.groupBy("doc").agg(F.max(is_nested.cast("int")).alias("nested"))
    entries = entries.join(nested_docs, "doc")
    models = at(v, "$.models")
    nested = entries.filter("nested = 1").select(F.coalesce(text(v, "$.id"), F.col("key")).alias("provider"), F.explode(F.from_json(F.when(kind(models) == "OBJECT", F.to_json(models)), "map<string,string>")).alias("model", "body"))
    nested = nested.select("provider", "model", F.try_parse_json("body").alias("v")).filter(kind(F.col("v")) == "OBJECT")
    paths = {"input": "$.cost.input", "output": "$.cost.output", "cache_read": "$.cost.cache_read", "input_200k": "$.cost.context_over_200k.input", "output_200k": "$.cost.context_over_200k.output", "cache_read_200k": "$.cost.context_over_200k.cache_read"}
    from_nested = nested.select(
        F.concat("provider", F.lit("/"), "model").alias("price_key"),
        *[(per_token(number(v, paths[c])) if c in paths else F.lit(None).cast("double")).alias(c) for c in PRICES],
        number(v, "$.limit.context").cast("long").alias("context_limit"), number(v, "$.limit.output").cast("long").alias("output_limit"),
    )
    flat = {
        "input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost",
        "input_200k": "input_cost_per_token_above_200k_tokens", "output_200k": "output_cost_per_token_above_200k_tokens", "cache_read_200k": "cache_read_input_token_cost_above_200k_tokens", "cache_write_200k": "cache_creation_input_token_cost_above_200k_tokens",
    }
    from_flat = entries.filter("nested = 0").select(
        F.col("key").alias("price_key"), *[number(v, f"$.{flat[c]}").alias(c) for c in PRICES],
        number(v, "$.max_input_tokens").cast("long").alias("context_limit"), number(v, "$.max_output_tokens").cast("long").alias("output_limit"),
    )
    return from_nested.unionByName(from_flat)


def price_keys(agent: str) -> list[Column]:
    """Keys to look up, in order, from provider_code and model_code."""
    provider, model = F.col("provider_code"), F.col("model_code")
    if agent == "opencode":
        return [names.price_key_opencode(provider, model)]
    if agent == "pi":
        return [names.price_key_pi(provider, model)]
    prefix, bare = {"claude": ("anthropic/", names.claude_alias(model)), "codex": ("openai/", model), "gemini": ("google/", model)}[agent]
    return [F.concat(F.lit(prefix), bare), bare]


def with_prices(events: DataFrame, prices: DataFrame, agent: str) -> DataFrame:
    """Events with struct `price`, null where no key is in the list.

    With two keys the first that is listed counts as a whole row, never price by price.
    """
    listed = small(prices.select("price_key", F.struct(*[F.col(c) for c in PRICES]).alias("price")))
    out = events
    for n, key in enumerate(price_keys(agent)):
        out = out.withColumn(f"key__{n}", key).join(listed.select(F.col("price_key").alias(f"key__{n}"), F.col("price").alias(f"price__{n}")), f"key__{n}", "left")
    found = [c for c in out.columns if c.startswith("price__")]
    price = F.col(found[0]) if len(found) == 1 else F.when(F.col(found[0]).isNotNull(), F.col(found[0])).otherwise(F.col(found[1]))
    return out.withColumn("price", price).select(*events.columns, "price")
