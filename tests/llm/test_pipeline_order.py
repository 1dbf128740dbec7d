"""The order of the mix in the pipeline's result, after documents were stored and read again."""

import corpus_pipeline
from meterlake.llm import mixing
from meterlake.llm.common import stored


def test_places_survive_the_store(spark):
    rows = [(i, f"some words {i}", "en", f"src{i % 7 % 3}", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = [(r["doc_id"], r["mix_slot"], r["mix_block_row"]) for r in mixing.mix_sources(docs).collect()]
    again = stored(corpus_pipeline.source_mix(spark, docs, ""), "mixed")
    got = [(r["doc_id"], r["mix_slot"], r["mix_block_row"]) for r in corpus_pipeline.tokens(spark, again, "").collect()]
    assert sorted(got) == sorted(want)
    assert len({x[1:] for x in got}) == len(rows)
