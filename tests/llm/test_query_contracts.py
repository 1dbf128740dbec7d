"""The registered queries on a table of odd texts, every contract column against brute force."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from meterlake.llm import licenses, queries
from test_operators import texts

LONG = "the MIT License of all rights reserved " * 20_000 + "x" * 200_000


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en" if i % 2 else None, f"src{i % 3}", 1) for i, t in enumerate([*texts(), LONG, "½ ² Ⅷ"])]
    return made + [made[3], made[-3]]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def found(spark, folder, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect())


def test_op1(spark, folder, rows):
    want = []
    for d, t, *_ in rows:
        n, starts, labels = brute.licences(t)
        want.append((d, n, len(starts), min(starts, default=None), max(starts, default=None), labels))
    got = queries.op1_license_scan(spark, folder).collect()
    key = lambda r: (r[0], str(r))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert 0 <= r["score"] <= 1
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
    assert "mit" in next(r["labels"] for r in got if r["doc_id"] == len(texts()))


@pytest.mark.parametrize(("text", "label"), [
    ("This program is free software; GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2.0"),
    ("MIT License\n\nCopyright", "mit"), ("Apache License 2.0", "apache-2.0"), ("Apache License, Version 2.0", "apache-2.0"), ("BSD 3-Clause License", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("the Mozilla Public License, v. 2.0", None), ("a licence of the general public", None),
])
def test_notices_as_they_are_written(text, label):
    index = licenses.RareWordIndex(licenses.NOTICES, {b"license": 900, b"the": 1000, b"version": 500}, 1000)
    labels = {index.templates[k].label for k, _, share in index.matches(licenses.words_of(text.encode())) if share >= 0.6}
    assert labels == ({label} if label else set())


def test_op2(spark, folder, rows):
    prints = [(d, brute.fingerprint(t)) for d, t, *_ in rows]
    near = brute.near_components(prints)
    assert found(spark, folder, "op2_simhash", "doc_id", "fingerprint", "component_id") == sorted((d, f"{f:016x}", near[d]) for d, f in prints)


def test_op3(spark, folder, rows):
    got = {}
    for r in queries.op3_pii(spark, folder).collect():
        got[r["doc_id"]] = r
        assert 0 <= r["top_score"] <= 1
    assert len(got) == len({d for d, *_ in rows})
    for d, t, *_ in rows:
        spans, r = brute.pii_spans(t), got[d]
        assert [r[f"n_{k}"] for k in brute.PII] == [sum(s[0] == k for s in spans) for k in brute.PII]
        assert r["base_sha256"] == brute.digest(spans)
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if s.split(":")[0] in brute.PII] == [f"{k}:{s}:{e}" for k, s, e in spans]
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_op5(spark, folder, rows):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    base = lambda q: q[0] < 20 or 100 * q[4] > 30 * q[0]
    short = [(d, t) for d, t, *_ in rows if t != LONG]
    want = sorted((d, *(q := brute.quality(t)), base(q)) for d, t in short)
    long_id = next(d for d, t, *_ in rows if t == LONG)
    got = found(spark, folder, "op5_quality_rules", *columns)
    assert [r for r in got if r[0] != long_id] == want
    assert [r[1:] for r in got if r[0] == long_id] == [(140_001, 640_000 + 200_000, 0, 0, 140_000, True)]


def test_op8(spark, folder, rows):
    got = queries.op8_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        text = dict((d, t) for d, t, *_ in rows)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and r["lang_pred"] in ("en", "und")


def test_op9(spark, folder, rows):
    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, *_ in rows:
        ids = ref.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest()))
    assert found(spark, folder, "op9_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
