"""Target weights of the mix, its bounds, and odd tables."""

import random

import brute
import pytest
from meterlake.llm import mixing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    """A hot source, rows without id or source, repeated rows, and columns with names used inside."""
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(None, "hot")] * 5 + [(7, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    for n in ("key", "m", "w", "slots", "bucket", "md5", "id", "doc", "start", "n", "mix__key", "mix_slot", "a.b"):
        d = d.withColumn(n, F.lit(n))
    return d


def targets(spark):
    return spark.createDataFrame([("hot", 1.0), (None, 0.5), *[(f"s{i}", 2.0 + i) for i in range(5)]], "source string, weight double")


def test_every_prefix_is_within_a_block_of_its_target(spark, docs):
    weights = mixing.target_weights(targets(spark))
    m = {r["key"]: r["m"] for r in weights.collect()}
    want, w = brute.mixed_slots(m), sum(m.values())
    placed = mixing.mix_sources(docs, weights, block_rows=4).collect()
    assert len(placed) == docs.count()
    key = {r["source"]: "" if r["source"] is None else "=" + r["source"] for r in placed}
    assert all(want[r["mix_slot"] % w] == key[r["source"]] for r in placed)
    # while every source has blocks left, each has had its share of the slots so far, within one block
    blocks = sorted({(r["mix_slot"], r["source"]) for r in placed}, key=lambda x: x[0])
    first_end = min(max(s for s, k in blocks if k == src) for src in key)
    for t in range(1, first_end + 1):
        for src, k in key.items():
            assert abs(sum(1 for s, x in blocks if x == src and s < t) - t * m[k] / w) < 1


def test_columns_stay(docs):
    got = mixing.mix_sources(docs, block_rows=4)
    assert got.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_row", "mix_block", "mix_slot", "mix_block_row"]
    ordered = mixing.in_mixed_order(docs, block_rows=4)
    assert ordered.columns == docs.columns and ordered.filter("mix_slot <> 'mix_slot' or key <> 'key'").isEmpty() and ordered.count() == docs.count()
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_weights_that_cannot_be_met_are_errors(spark, docs):
    t = targets(spark)
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix_sources(docs, mixing.target_weights(t.filter("source <> 's1' or source is null")))
    for wrong in (t.union(t.limit(1)), t.withColumn("weight", F.lit(0.0)), t.withColumn("weight", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="weight above 0"):
            mixing.target_weights(wrong)


def test_many_small_sources_leave_a_large_one_its_share(spark):
    rows = [("big", 1000.0), *[(f"s{i}", 1.0) for i in range(1000)]]
    m = {r["key"]: r["m"] for r in mixing.target_weights(spark.createDataFrame(rows, "source string, weight double")).collect()}
    assert abs(m["=big"] / sum(m.values()) - 0.5) < 0.05


def slots_by_halves(spark, m):
    places = mixing.frame_places(spark.createDataFrame(list(m.items()), "key string, m long")).collect()
    return [r["key"] for r in sorted(places, key=lambda r: r["slot"])], sorted(r["slot"] for r in places)


def test_halves_give_the_schedule_of_one_slot_after_another(spark):
    draw = random.Random(3)
    frames = [{"=a": 1}, {"=a": 5}, {"=a": 2, "=b": 1}, {"=a": 700, "=b": 1, "": 1}, {f"={i}": 1 for i in range(100)}]
    frames += [{f"={i}": draw.choice((1, 1, 2, 7, 60)) for i in range(draw.randint(2, 40))} for _ in range(6)]
    frames.append({"=hot": 1200, **{f"={i}": draw.randint(1, 9) for i in range(300)}})  # over two ranges that are dealt within a partition
    for m in frames:
        got, slots = slots_by_halves(spark, m)
        assert slots == list(range(sum(m.values()))) and got == brute.mixed_slots(m)
    assert slots_by_halves(spark, {"=a": 1})[0] == ["=a"] and mixing.frame_places(spark.createDataFrame([], "key string, m long")).isEmpty()


def test_a_large_frame_places_documents_like_a_small_one(spark, docs, monkeypatch):
    weights = mixing.target_weights(targets(spark))
    places = lambda: sorted((r["mix_slot"], r["mix_block_row"], str(r["doc_id"]), str(r["source"])) for r in mixing.mix_sources(docs, weights, block_rows=4).collect())
    want = places()
    monkeypatch.setattr(mixing, "FOLD_STEPS", 0)
    assert places() == want
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_twenty_thousand_sources_stay_within_a_block_of_their_targets(spark):
    sources = spark.range(20_000).select(F.col("id").cast("string").alias("source"), F.when(F.col("id") == 0, 10_000.0).otherwise(1.0 + F.col("id") % 5).alias("weight"))
    weights = mixing.target_weights(sources)
    w = weights.agg(F.sum("m")).first()[0]
    placed = mixing.frame_places(weights).join(weights, "key").persist()
    assert placed.count() == w and placed.select("slot").distinct().count() == w
    # each block lies in its window, which is what keeps the deviation below one block after any number of slots
    assert placed.filter(f"slot < j * {w} div m or slot >= ((j + 1) * {w} + m - 1) div m").isEmpty()
    placed.unpersist()
