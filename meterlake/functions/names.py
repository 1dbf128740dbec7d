"""Model, path and id names (FN-07..16)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_free(model: Column) -> Column:
    """Model without any trailing `:free` or `-free`."""
    return F.regexp_replace(model, "(?:[:-]free)+$", "")


def strip_suffixes(model: Column) -> Column:
    """Model up to its first colon, without trailing `-free`."""
    return F.regexp_replace(F.regexp_replace(model, "(?s):.*$", ""), "(?:-free)+$", "")


def _keyed(prefix: str, model: Column) -> Column:
    return F.concat(F.lit(prefix), model)


def price_key_opencode(provider: Column, model: Column) -> Column:
    """provider/model key of the price list; the first rule that applies wins."""
    m = strip_free(model)
    own = provider == "opencode"
    return (
        F.when(m.startswith("gpt"), _keyed("openai/", m))
        .when(provider == "openrouter", _keyed("openrouter/", m))
        .when(own & m.startswith("minimax-m2.1"), _keyed("minimax/", F.replace(m, F.lit("minimax-m"), F.lit("MiniMax-M"))))
        .when(own & m.startswith("glm-4.7"), _keyed("openrouter/z-ai/", m))
        .when(own & (m == "grok-code"), F.lit("xai/grok-code-fast-1"))
        .otherwise(F.concat(provider, F.lit("/"), m))
    )


def price_key_pi(provider: Column, model: Column) -> Column:
    m = strip_suffixes(model)
    return (
        F.when(m.startswith("gpt"), _keyed("openai/", m))
        .when(provider == "openrouter", _keyed("openrouter/", m))
        .when((provider == "opencode") & (m == "grok-code"), F.lit("xai/grok-code-fast-1"))
        .otherwise(F.concat(provider, F.lit("/"), m))
    )


def claude_alias(model: Column) -> Column:
    """A model that is priced as its predecessor takes that name; exact text only."""
    return F.when(model == "claude-opus-4-7", F.lit("claude-opus-4-6")).otherwise(model)


def with_speed(model: Column, speed: Column) -> Column:
    return F.when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)


def uuid_text(value: Column) -> Column:
    """Lower-case UUID with dashes, or null; braces, `urn:uuid:` and missing dashes are accepted."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(value, "^(?i)urn:uuid:", ""), "[{}-]", ""))
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def project_name(path: Column, roots: list[str]) -> Column:
    """First part of the path under the first root that holds it; null outside all roots. Local paths and roots may be file: URIs."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    under = [F.when(plain.startswith(r := re.sub("^file:/+", "/", root).rstrip("/") + "/"), F.split_part(F.substr(plain, F.lit(len(r) + 1)), F.lit("/"), F.lit(1))) for root in roots]
    return F.coalesce(*under) if under else F.lit(None).cast("string")


def session_id_from_file(path: Column) -> Column:
    """What stands between the last underscore and `.jsonl` of a file name; null if nothing."""
    return F.nullif(F.regexp_extract(path, "_([^_/]*)\\.jsonl$", 1), F.lit(""))


def cwd_from_parent(path: Column) -> Column:
    """Working directory of a parent directory named `--a-b--`: /a/b; null for other names."""
    inner = F.regexp_extract(path, "/--([^/]*)--/[^/]*$", 1)
    return F.when(inner != "", F.concat(F.lit("/"), F.translate(inner, "-", "/")))
