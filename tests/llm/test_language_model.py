"""The CRF against enumeration and finite differences, and its training sample."""

from itertools import product

import numpy as np
import pytest
from meterlake.llm import language
from pyspark.sql import functions as F


def log_sum(scores, transitions):
    """Log of the sum over all labellings, one by one."""
    k = scores.shape[1]
    paths = [sum(scores[i, y] for i, y in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:])) for p in product(range(k), repeat=len(scores))]
    return np.logaddexp.reduce(paths)


def test_pair_marginals_are_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    scores, transitions, eps = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), 1e-5
    p, pairs = language.marginals(scores.astype(np.float32), np.array([6]), transitions.astype(np.float32), with_pairs=True)
    for a in range(3):
        for b in range(3):
            step = np.zeros((3, 3))
            step[a, b] = eps
            assert pairs[a, b] == pytest.approx((log_sum(scores, transitions + step) - log_sum(scores, transitions - step)) / (2 * eps), abs=1e-4)
    for i in range(6):
        for c in range(3):
            step = np.zeros((6, 3))
            step[i, c] = eps
            assert p[i, c] == pytest.approx((log_sum(scores + step, transitions) - log_sum(scores - step, transitions)) / (2 * eps), abs=1e-4)


def test_pair_marginals_across_blocks_and_texts():
    """Over blocks and several texts: rows and columns of the pairs add up to the word marginals."""
    rng = np.random.default_rng(4)
    sizes = np.array([1, 300, 128, 0, 129, 2])
    scores, transitions = rng.normal(size=(sizes.sum(), 4)).astype(np.float32), rng.normal(size=(4, 4)).astype(np.float32)
    p, pairs = language.marginals(scores, sizes, transitions, with_pairs=True)
    full = sizes[sizes > 0]
    ends, starts = np.cumsum(full) - 1, np.cumsum(full) - full
    assert np.allclose(pairs.sum(axis=1), np.delete(p, ends, 0).sum(axis=0), atol=1e-2)
    assert np.allclose(pairs.sum(axis=0), np.delete(p, starts, 0).sum(axis=0), atol=1e-2)
    one = [language.marginals(scores[s : s + n], np.array([n]), transitions, with_pairs=True)[1] for s, n in zip(starts, full)]
    assert np.allclose(pairs, sum(one), atol=1e-2)


def test_numerals_are_no_letters(spark):
    model = language.fit([("the cat sat", "en"), ("der hund lief", "de")] * 5)
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "½ cat"), (3, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"


def test_training_sample(spark):
    """A rare label and long texts are learned; repeated and null ids give the same sample however rows are dealt."""
    rows = [(i, f"word{i} and more", "en") for i in range(300)] + [(1000 + i, "selten genug " * (3 + i), "de") for i in range(2)]
    rows += [(None, f"no id {i % 3}", "en") for i in range(60)] + [(5, "x" * 500 + " lang", "fr")] * 40 + [(6, "12 - 3", "nn"), (7, None, "en"), (8, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    took = lambda df: language.training_rows(df, sample_rows=30, sample_chars=20)
    first = took(docs.repartition(3))
    assert first == took(docs.repartition(7, "text")) == took(docs.orderBy(F.desc("text")))
    assert {y for _, y in first} == {"en", "de", "fr"}
    assert sum(y == "en" for _, y in first) == 10 and sum(y == "fr" for _, y in first) == 1 and sum(y == "de" for _, y in first) == 2
    assert all(len(t) <= 20 for t, _ in first)
    assert took(docs.filter("false")) == []
