"""Cost of an event from the prices joined to it (FN-19..26)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Input above this many tokens is billed at the long-context prices.
TIER = 200_000


@dataclass(frozen=True)
class CostRule:
    """How an agent's counters are billed.

    context_tier: cached and cache-write tokens count toward the tier. input_has_cached: input
    includes cached tokens. output: "plain", "split" (output includes reasoning) or "added"
    (reasoning comes on top, both held at 0 or more). cache_write: cache writes are billed.
    """

    context_tier: bool = False
    input_has_cached: bool = False
    output: str = "plain"
    cache_write: bool = False
    free_providers: tuple[str, ...] = ()


RULES = {
    "claude": CostRule(context_tier=True, cache_write=True),
    "codex": CostRule(input_has_cached=True, output="split"),
    "opencode": CostRule(output="split", cache_write=True, free_providers=("lmstudio",)),
    "pi": CostRule(cache_write=True, free_providers=("lmstudio",)),
    "gemini": CostRule(input_has_cached=True, output="added"),
}


def not_below_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast("long"))


def shown_input(agent: str) -> Column:
    """Input tokens without cached ones, as reports show them."""
    plain = F.col("input_tokens")
    return not_below_zero(plain - F.col("cache_read_tokens")) if RULES[agent].input_has_cached else plain


def shown_output(agent: str) -> Column:
    """Output tokens without reasoning, as reports show them."""
    plain = F.col("output_tokens")
    return not_below_zero(plain - F.col("reasoning_tokens")) if RULES[agent].output == "split" else plain


def event_cost(agent: str, price: str = "price") -> Column:
    """USD of an event (canonical counters) at the per-token prices in struct `price`; no price costs 0.

    A missing long-context price falls back to the base price. A missing cache-write price is
    the base input price, on either side of the tier.
    """
    rule = RULES[agent]
    p = F.col(price)
    measure = F.col("input_tokens")
    if rule.context_tier:
        measure = measure + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    over, zero = measure > TIER, F.lit(0.0)
    tiered = lambda name: F.coalesce(F.when(over, p[f"{name}_200k"]), p[name], zero)
    billed = {"plain": F.col("output_tokens"), "split": shown_output(agent) + F.col("reasoning_tokens"), "added": not_below_zero(F.col("output_tokens")) + not_below_zero(F.col("reasoning_tokens"))}[rule.output]
    total = shown_input(agent) * tiered("input") + billed * tiered("output") + F.col("cache_read_tokens") * tiered("cache_read")
    if rule.cache_write:
        total = total + F.col("cache_write_tokens") * F.coalesce(F.when(over, p["cache_write_200k"]), p["cache_write"], p["input"], zero)
    if rule.free_providers:
        total = F.when(F.col("provider_code").isin(*rule.free_providers), zero).otherwise(total)
    return total


def exact_sum(cost: Column) -> Column:
    """Sum that doesn't depend on the order of rows."""
    return F.sum(cost.cast("decimal(28,10)")).cast("double")
