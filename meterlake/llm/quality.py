"""Operator 5: quality rules with host-level verdicts (native columns only).

Every document is tested by rules over its words and lines. Failures are counted by host
(the column `source`), each host's failure rate is shrunk toward an empirical beta prior
fitted to all hosts by moments, and the verdict on bad hosts is joined back: a document goes
if it fails a hard rule, or if its host is bad and it fails a soft rule itself. A host is bad
if its rate is more than `bad_ratio` times the mean of the prior with a posterior probability
of 95 %. The spread that chance alone gives to raw rates is taken off before the prior is
fitted: hosts that differ by chance have a prior so narrow that none of them is bad, and a
small host needs the more failures.

The texts are measured once: the measures are stored, hosts are counted from those, and the
verdict joins the stored rows. Texts are never shuffled by host; bad hosts join as a broadcast
while they are few, else the suspects alone are joined, salted, and dropped by row number.
A verdict depends on text and host alone, so documents are kept by two 64-bit hashes of those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words are runs without these characters.
_SPACE = "[ \\t-\\r]"
WINDOW = 8
#: Up to so many bad hosts are broadcast; beyond, the join shuffles the suspects, in so many parts of each host.
FEW_HOSTS, SALTS = 20_000, 32
#: Up to so many different dropped texts are told to all tasks by their hashes; beyond, the texts are shuffled by them.
FEW_DROPPED = 500_000
LEAST_WORDS = 20
#: Standard deviations below the mean that a normal value exceeds with a probability of 95 %.
SURE = 1.645
MEASURES = ("q_words", "q_word_chars", "q_symbols", "q_lines", "q_dup_lines", "q_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with the value computed once and not once per element of a lambda."""
    return F.transform(F.array(value), body)[0]


def _repeats(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: the union of runs of WINDOW words."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ranked: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.filter(F.transform(ranked, lambda x, i: F.when(same(F.get(ranked, i - 1), x) | same(F.get(ranked, i + 1), x), x["p"])), lambda p: p.isNotNull())

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return _let(F.sort_array(_let(ranked, repeated)), covered)


def _measured(docs: DataFrame, carried: Column, host_col: str, text_col: str) -> DataFrame:
    """(doc, host, q_words, q_word_chars, q_symbols, q_lines, q_dup_lines, q_repeat_words long, base_failed, soft_failed): `doc` is the carried value.

    Null and empty texts count as zero words. Window equality is by 64-bit hash within a text.
    """
    docs = docs.select(carried.alias("doc"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    words = F.array_remove(F.split(text, f"{_SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))

    def window_hashes(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1)))
        return F.when(F.size(w) > WINDOW, F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def repeated_words(w: Column) -> Column:
        # most texts repeat no window and are done after the count of distinct hashes
        return _let(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeats(h)).otherwise(F.lit(0)))

    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different")))
    out = docs.select("doc", "host", "text", of_words.alias("w"), of_lines.alias("l"))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    values = (F.col("w.n"), F.col("w.chars"), symbols, F.col("l.n"), F.col("l.n") - F.col("l.different"), F.col("w.repeats"))
    out = out.select("doc", "host", *[v.cast("long").alias(k) for k, v in zip(MEASURES, values, strict=True)])
    return out.withColumns({"base_failed": _any(HARD), "soft_failed": _any(SOFT)})


#: Rules of the base: a document that fails one goes.
HARD: dict[str, Column | Callable[[], Column]] = {
    "too_short": lambda: F.col("q_words") < LEAST_WORDS,
    "repetitive": lambda: 100 * F.col("q_repeat_words") > 30 * F.col("q_words"),
}
#: Rules that count against the host, and against a document of a bad host.
SOFT: dict[str, Callable[[], Column]] = {
    "symbols": lambda: 10 * F.col("q_symbols") > F.col("q_words"),
    "dup_lines": lambda: 10 * F.col("q_dup_lines") > 3 * F.col("q_lines"),
    "word_length": lambda: (F.col("q_word_chars") < 2 * F.col("q_words")) | (F.col("q_word_chars") > 12 * F.col("q_words")),
}


def _any(rules: dict) -> Column:
    return reduce(lambda a, b: a | b, (rule() for rule in rules.values()))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate, sure, prior): failure rate by host of rows (host, base_failed, soft_failed), shrunk by the empirical beta prior.

    Mean m and variance of the prior are those of the raw rates over hosts, the variance less
    what drawing n documents of a host at rate m adds, m (1 - m) / n on average. Strength
    m (1 - m) / v - 1 is held between 1 and 1e6, and 1e6 if no variance is left. `sure` is the
    rate that a host exceeds with a probability of 95 %, by the normal approximation of its
    posterior. A null host is a host of its own.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    m = F.avg(raw)
    v = F.var_pop(raw) - m * (1 - m) * F.avg(1 / F.col("n"))
    strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = hosts.agg(m.alias("mean"), strength.alias("strength"))
    # the prior is one row, whatever the input
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    found = hosts.join(F.broadcast(prior)).withColumn("rate", shrunk)
    sure = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return found.select("host", "n", "failed", "rate", sure.alias("sure"), F.col("mean").alias("prior"))


def _verdicts(docs: DataFrame, carried: Column, bad_ratio: float, host_col: str, text_col: str) -> DataFrame:
    """Measured rows with `kept`."""
    rows = stored(_measured(docs, carried, host_col, text_col).withColumn("row", F.monotonically_increasing_id()), "quality")
    bad = host_rates(rows).filter(F.col("sure") > F.col("prior") * bad_ratio).select(F.col("host").alias("bad_host"))
    few = bad.limit(FEW_HOSTS + 1).collect()
    fine = ~F.col("base_failed")
    if len(few) <= FEW_HOSTS:
        bad = F.broadcast(rows.sparkSession.createDataFrame(few, bad.schema))
        hit = rows.join(bad.withColumn("hit", F.lit(True)), F.col("host").eqNullSafe(F.col("bad_host")), "left")
        return hit.withColumn("kept", fine & ~(F.col("hit").isNotNull() & F.col("soft_failed")))
    suspects = rows.filter(fine & F.col("soft_failed")).select("row", "host", F.pmod("row", F.lit(SALTS)).alias("salt"))
    salted = bad.select("bad_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    dropped = suspects.join(salted, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("salt") == F.col("bad_salt"))).select("row", F.lit(True).alias("hit"))
    return rows.join(dropped, "row", "left").withColumn("kept", fine & F.col("hit").isNull())


def judge(docs: DataFrame, *, bad_ratio: float = 1.25, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, q_words, q_word_chars, q_symbols, q_lines, q_dup_lines, q_repeat_words, base_failed, kept) of every row; booleans are never null.

    Null and empty texts count as zero words and fail, null ids and hosts are values like
    others, repeated rows come out once each, empty input gives no rows. Only the three named
    columns are read, so others may have any name.
    """
    found = _verdicts(docs, F.col(id_col), bad_ratio, host_col, text_col)
    return found.select(F.col("doc").alias(id_col), *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, *, bad_ratio: float = 1.25, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns of `docs` as they are, whatever their names; repeated rows stay."""
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(host_col).cast("string")
    parts = (text, F.coalesce(host, F.lit("")), host.isNull())
    key = F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))
    dropped = _verdicts(docs, key, bad_ratio, host_col, text_col).filter(~F.col("kept")).select("doc.k1", "doc.k2").distinct()
    few = F.broadcast(dropped) if dropped.count() <= FEW_DROPPED else dropped
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    # short texts, the likeliest to repeat without end, go before the join
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit("")), f"{_SPACE}+"), ""))
    return whole.filter(words >= LEAST_WORDS).join(few, (F.col("key.k1") == F.col("k1")) & (F.col("key.k2") == F.col("k2")), "left_anti").select("doc.*")
