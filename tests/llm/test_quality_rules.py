"""Host verdicts and odd tables of the quality rules."""

import random

import brute
import pytest
from meterlake.llm import quality
from pyspark.sql import functions as F

FINE = " ".join(f"word{i}" for i in range(40))
DOUBTFUL = FINE + " #" * 8


@pytest.fixture(scope="module")
def hosts(spark):
    """Hosts with few, some and many failing documents; each has fine and doubtful ones; the failing ones of three hosts are equal texts."""
    rows = [(h * 1000 + i, "short" if i < bad else (DOUBTFUL if i % 2 else FINE), None if h == 3 else f"h{h}") for h, bad in enumerate((0, 1, 2, 56, 58, 1)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def wanted(rows, ratio):
    """kept ids by plain Python: shrunk rates against the mean of the prior."""
    failed, of = {}, {}
    for d, t, h in rows:
        words = t.split()
        hard, soft = len(words) < 20, 10 * t.count("#") > len(words)
        of.setdefault(h, []).append((d, hard, soft))
        failed[h] = failed.get(h, 0) + (hard or soft)
    bad = brute.bad_hosts({h: (failed[h], len(of[h])) for h in of}, ratio)
    assert 0 < len(bad) < len(of)
    return {d for h, ds in of.items() for d, hard, soft in ds if not hard and not (h in bad and soft)}


def test_bad_hosts_by_broadcast_and_by_salted_join(spark, hosts, monkeypatch):
    want = wanted([tuple(r) for r in hosts.collect()], 1.25)
    assert {r["doc_id"] for r in quality.keep_good(hosts).collect()} == want
    monkeypatch.setattr(quality, "FEW_HOSTS", 0)
    monkeypatch.setattr(quality, "FEW_DROPPED", 0)
    assert {r["doc_id"] for r in quality.keep_good(hosts).collect()} == want
    assert {r["doc_id"] for r in quality.judge(hosts).filter("kept").collect()} == want


def test_hosts_alike_lose_nothing(spark):
    """Where all hosts fail alike, a doubtful document stays."""
    rows = [(h * 1000 + i, "short" if i < 5 else DOUBTFUL, f"h{h}") for h in range(4) for i in range(50)]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.count() == 4 * 45


def test_columns_of_the_documents_are_returned_untouched(spark, hosts):
    names = ("kept", "base_failed", "soft_failed", "q_words", "doc", "host", "row", "w", "l", "hit", "a.b")
    docs = hosts
    for n in names:
        docs = docs.withColumn(n, F.lit(f"mine {n}"))
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    first = got.first().asDict()
    assert all(first[n] == f"mine {n}" for n in names)
    assert got.count() == quality.keep_good(hosts).count()
    assert quality.judge(docs).filter("kept").count() == got.count()
    assert quality.keep_good(docs.filter("false")).columns == docs.columns and quality.keep_good(docs.filter("false")).count() == 0


def test_a_very_long_text(spark):
    """Some megabytes of words; one window stands twice."""
    words = [f"w{i}" for i in range(300_000)]
    text = " ".join(words + words[:8])
    got = quality.judge(spark.createDataFrame([(1, text, "s"), (None, None, None)], "doc_id long, text string, source string")).orderBy("doc_id").collect()
    assert (got[1]["q_words"], got[1]["q_repeat_words"], got[1]["kept"]) == (300_008, 16, True)
    assert (got[0]["q_words"], got[0]["kept"]) == (0, False)


def judged(spark, rates, n, seed):
    """Rates of hosts whose documents fail by chance, and the hosts that are bad."""
    rng = random.Random(seed)
    rows = [(h, rng.random() < rate, False) for h, rate in enumerate(rates) for _ in range(n)]
    found = quality.host_rates(spark.createDataFrame(rows, "host long, base_failed boolean, soft_failed boolean")).collect()
    counts = {r["host"]: (r["failed"], r["n"]) for r in found}
    bad = {r["host"] for r in found if r["sure"] > 1.25 * r["prior"]}
    assert bad == brute.bad_hosts(counts)
    return bad


def test_hosts_that_differ_by_chance_are_not_bad(spark):
    for seed in range(6):
        assert judged(spark, [0.15] * 20, 50, seed) == set()


def test_a_planted_bad_host_is_found(spark):
    for seed in range(4):
        assert judged(spark, [0.15] * 19 + [0.7], 50, seed) == {19}
