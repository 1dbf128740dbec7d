"""Queries and the pipeline over the smallest tables, against SQL and brute force."""

import os

import brute
import corpus_pipeline
import duckdb
import pytest
from meterlake.llm import mixing, pii, queries
from pyspark.sql import functions as F
from test_similar import all_pairs

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(sorted(got.columns))
    want = con.execute(f"select {columns} from ({queries.ORACLE_SQL[name]}) x").fetchall()
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=key) == sorted(want, key=key)


def expected_texts(rows):
    """id -> masked text of what the stages keep, by plain Python. rows: id -> (text, source)."""
    measured = {d: brute.quality(t) for d, (t, _) in rows.items()}
    fine = {d: (rows[d][0] or "") for d in brute.kept_by_quality({d: (m, *rows[d]) for d, m in measured.items()})}
    groups = all_pairs(sorted(fine.items()))
    return {d: pii.masked(t, pii.find_spans(t)) for d, t in fine.items() if groups[d] == d}


def test_pipeline(spark, sf_dir):
    """All stages against plain Python: who stays (host verdicts, all pairs of 5-word shingle sets), what is masked, what is encoded."""
    import hashlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = expected_texts({r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, text in want.items():
        ids = np.array(ref.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
        assert (got[d]["n_tokens"], got[d]["ids"], got[d]["ids_sha256"]) == (len(ids) // 4, bytes(ids), hashlib.sha256(ids).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), sf_dir).columns == docs.columns


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, an empty and a very long text, repeated rows, and extra columns with names used inside."""
    fine = " ".join(f"word{i}" for i in range(30))
    rows = [(1, fine, "en", "a", 9), (1, fine, "en", "a", 9), (2, fine + " more", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, fine + " mail me@x.de", "en", "b", 5), (None, None, None, None, None),
            (5, " ".join(f"w{i}" for i in range(200_000)), "en", "b", 1), (6, " ".join(f"other{i}" for i in range(30)) + " call +49 170 1234567", "de", "b", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for n in ("id", "doc", "key", "kept", "row", "node", "component", "rep", "spans", "masked", "mix_row", "a.b"):
        d = d.withColumn(n, F.lit(n))
    return d


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, odd, sf_dir, name, stage):
    got = stage(spark, odd, sf_dir)
    ids = sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=lambda d: (d is not None, d or 0))
    want = {"quality_rules": [None, 1, 1, 2, 5, 6], "near_duplicates": [None, None, 1, 3, 5, 6]}
    assert ids == want.get(name, [None, None, 1, 1, 2, 3, 4, 5, 6])
    if name != "tokens":
        assert got.columns == odd.columns
        assert all(r[c] == c for r in got.collect() for c in ("id", "doc", "key", "kept", "row", "node", "mix_row", "a.b"))
    if name == "personal_data":
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect() if r["doc_id"] is not None}
        assert texts[6][0].endswith("call [PHONE]") and texts[6][1] == len(texts[6][0]) and texts[3] == (None, None)
    assert stage(spark, odd.filter("false"), sf_dir).count() == 0


def test_order_survives_storage_in_several_files(spark, sf_dir, tmp_path):
    """run() over documents in many files: places are those of the schedule of what the earlier stages kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["mix_slot"], r["mix_block_row"], r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))
    kept = docs.join(spark.createDataFrame([(d,) for *_, d in got], "doc_id long"), "doc_id")
    want = sorted((r["mix_slot"], r["mix_block_row"], r["doc_id"]) for r in mixing.mix_sources(kept).collect())
    assert got == want and len({x[:2] for x in got}) == len(got)


def test_pipeline_order_follows_slots(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_block_row"]) for r in mixing.mix_sources(docs).collect()}
    order = [slots[r["doc_id"]] for r in mixing.in_mixed_order(docs).select("doc_id").collect()]
    assert order == sorted(order)
