"""Statistics, rules and weights of the quality classifier by plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from meterlake.llm import queries, rules
from pyspark.sql import functions as F

TEXTS = ["One two  two.\nThree!", "", None, " \t\n ", "A|B|C #x $5 %", "same same same same", "ÀÉ émile 😀 ａｂ", "x" * 5000 + "\n" * 30, "The End. " * 50, "1234 5678 _ = ~ ^ & < >", "\x85nbsp\xa0word em"]


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(1, len(words)), max(1, len(text))
    share = lambda p: len(re.findall(p, text)) / chars
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)) / n, "upper": share("[A-Z]"), "marks": share("[#*$%&<>^~=_]"), "bars": share("[|]"), "bangs": share("!"), "stops": share("[.]"), "digits": share("[0-9]"),
        "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / n, "distinct": len(set(words)) / n, "lines_per_word": (text.count("\n") + 1) / n,
    }


def score(model, s):
    total = model.intercept + sum(w for rule, w in model.rules if all(s[name] > t if above else s[name] <= t for name, above, t in rule))
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    x = rng.random((400, len(rules.NAMES)))
    return rules.fit(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.6)).astype(float))


def test_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in rules.statistics(docs).collect():
        want = statistics(TEXTS[r["doc_id"]])
        for k in rules.NAMES:
            assert r[f"s__{k}"] == pytest.approx(want[k]), (r["doc_id"], k)


def test_scores_are_those_of_the_rules(spark, model):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, "repeated id"), (None, "no id")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = rules.score(docs, model).collect()
    assert len(got) == len(TEXTS) + 2
    texts = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    want = sorted((known, i, round(score(model, statistics(t)), 9)) for known, i, t in texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 9)) for r in got) == want
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_lasso_weights_are_at_the_optimum():
    """Slopes of the loss at the fitted weights: at most the penalty where a weight is 0, and the penalty against its sign elsewhere."""
    rng, penalty = np.random.default_rng(5), 0.01
    x = rng.random((300, len(rules.NAMES)))
    y = (x[:, 1] > 0.4).astype(float)
    m = rules.fit(x, y, penalty=penalty, rounds=20000, trees=4, depth=2)
    rows = [dict(zip(rules.NAMES, r, strict=True)) for r in x]
    wrong = np.array([score(m, r) for r in rows]) - y
    assert abs(wrong.mean()) < 1e-3
    for rule, w in m.rules:
        holds = np.array([all(r[n] > t if above else r[n] <= t for n, above, t in rule) for r in rows], float)
        assert abs(holds @ wrong / len(y) + math.copysign(penalty, w)) < 2e-3


def test_sample_doesnt_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(1)
    docs = [(i % 40, f"text {rng.random()}" * (i % 5 + 1)) for i in range(120)] + [(None, "no id")]
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (5, None), (7, 2)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    a = rules.training_rows(d.repartition(3), y.repartition(2), sample_rows=25)
    b = rules.training_rows(d.repartition(5, "text"), y.orderBy(F.desc("doc_id")), sample_rows=25)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert 0 < len(a[1]) <= 25


def test_query(spark, sf_dir):
    """The registered query against plain Python, with its own model."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = rules.fit(*rules.training_rows(docs, labels))
    want = {r["doc_id"]: round(score(m, statistics(r["text"])), 9) for r in docs.collect()}
    got = queries.op7_quality_classifier(spark, sf_dir).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in got} == want
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
