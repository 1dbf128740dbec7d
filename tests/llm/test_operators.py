"""Operators against brute force, on texts with nulls, blanks, long runs, repeats and odd columns."""

import math
import random

import brute
import numpy as np
import pytest
from meterlake.llm import chat, language, licenses, mixing, pieces, pii, quality, queries, rules, simhash, topk
from meterlake.llm.common import map_texts
from pyspark.sql import functions as F

WORDS = "the of and la der haus nion tion ment über été ñu re".split()
PLANTED = [
    "Released under the MIT License. All rights reserved. Licensed under CC BY-NC 4.0", "Licensed under the GNU General Public License, version 3 general public license", "CC-BY cc. by all rights\nreserved",
    "mail a.b@c.de.x and b@c.d@e.f, ip 1.2.3.4.5 and 999.1.1.1 and 010.0.0.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112; call +49 (0) 170-1234567 or +1234",
    "bank transfer iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789", "a" * 3000 + "@x.de " + "1" * 6000, "x y z " * 40, "line one here\nline one here\n\n \nother",
    "İSTANBUL ÀÉ 😀 words ａｂ", "#### || <b> $$", "", None, " \t\n", "one", "two words", None,
]


def texts(n=30, seed=3):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    near = [t + " tail" for t in made[:8]] + [t.replace("the", "of", 1) for t in made[8:14]]
    return made + near + made[:4] + PLANTED


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with every odd case, a row repeated, a null id, and columns that clash with working names."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", "x", 1) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id here", None, "src0", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id__ string, n long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_licences(docs, empty):
    want = sorted((d is not None, d or 0, *brute.licences(t)) for d, t in collected(docs))
    rows = licenses.scan_licenses(docs).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], sorted(m["start"] for m in r["matches"] if m["base"]), ",".join(sorted({m["label"] for m in r["matches"] if m["base"]}))) for r in rows)
    assert got == want
    assert {m["label"] for r in rows for m in r["matches"]} >= {"mit", "gpl-3.0", "cc-by-nc-4.0", "reserved", "cc-by", "gpl"}
    assert all(0 < m["score"] <= 1 for r in rows for m in r["matches"])
    assert licenses.scan_licenses(empty).count() == 0


def test_reworded_notice_within_slack():
    words = licenses.words_of(b"this work here is now licensed under terms of the gnu general public license version 3 only")
    index = licenses.RareWordIndex(licenses.NOTICES, {}, 1)
    assert "gpl-3.0" in {index.templates[k].label for k, *_ in index.matches(words)}
    assert not index.matches(licenses.words_of(b"the license of the public general"))


def test_simhash(docs, empty):
    rows = [(d, brute.fingerprint(t)) for d, t in collected(docs) if d is not None]
    want = brute.near_components(rows)
    for dense in (128, 1):  # at 1 every shared anchor takes the fine code
        got = simhash.near_duplicates(docs, dense_at=dense).filter("doc_id is not null").collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in got} == {d: (f, want[d]) for d, f in rows}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(want.values()))


def test_simhash_links_on_crowded_fingerprints(spark):
    """Fingerprints within a few bits of each other, in both codes, against all pairs."""
    rng, centre = random.Random(5), random.Random(6).getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(20)}
    rows = sorted(fps)
    want = brute.near_components([(f, f) for f in rows])
    signed = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in rows], "fp long")
    for dense in (1000, 5):
        linked = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(signed, dense_at=dense).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in linked)
        parts = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(signed, dense_at=dense)).collect()}
        for a in rows:
            for b in rows:
                if a in parts and b in parts:
                    assert (parts[a] == parts[b]) == (want[a] == want[b])
                elif a != b:
                    assert want[a] != want[b]


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.filter("false")).count() == 0


def test_pii(docs, empty):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for d, t in collected(docs):
        spans = [(s["kind"], s["start"], s["end"]) for s in by_id[d]["spans"]]
        assert [s for s in spans if s[0] in pii.BASE_KINDS] == brute.pii_spans(t)
        assert (by_id[d]["masked"] is None) == (t is None)
    assert {s["kind"] for r in rows for s in r["spans"]} == set(pii.KINDS)
    assert pii.find_pii(empty).count() == 0
    masked = pii.mask_documents(docs.withColumn("n_chars", F.lit(0).cast("long")))
    assert masked.filter("text like '%@x.de%'").isEmpty() and masked.filter("length(text) <> n_chars").isEmpty()


def test_pii_random_text():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-_ +()9é4") for _ in range(rng.randint(0, 40)))
        assert [(k, s, e) for s, k, e, _ in pii.find_spans(text) if k in pii.BASE_KINDS] == brute.pii_spans(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.score("ssn", "ssn 123-45-6789", 4, 15) > pii.score("ssn", "order 123-45-6789", 6, 17)


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(0, 260, 2)]
    rows += [(1, rows[0][1]), (100, [0.5] * 8), (100, rows[50][1]), (3, None), (5, [0.1, None]), (7, [math.nan] * 8), (9, [math.inf] * 8), (11, []), (13, [0.25]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string").repartition(3)
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == brute.top_k(rows)
    assert topk.top_k(df.filter("false")).count() == 0
    assert len(topk.top_k(df.filter("vec_id = 100 or vec_id = 2")).collect()) == 9  # three queries, three others each: fewer candidates than k


def test_top_k_large_values_and_ties():
    big = np.array([[2.0**52, 2.0**40]])
    assert topk.accumulate(big, big)[0, 0] == 2**63 - 1
    scores = np.array([5, 7, 7, 7, 1, topk._NONE])
    assert topk.select_top(scores, np.array([9, 8, 3, 5, 1, 0]), 2).tolist() == [2, 3]


def test_quality(docs, empty):
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    want = {d: brute.quality(t) for d, t in collected(docs)}
    for r in rows:
        assert (r["q_words"], r["q_word_chars"], r["q_symbols"], r["q_dup_lines"], r["q_repeat_words"]) == want[r["doc_id"]]
        n, *_, repeats = want[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_bad_host_takes_its_doubtful_documents(spark):
    fine = " ".join(f"word{i}" for i in range(40))
    doubtful = fine + " #" * 8
    rows = [(i, fine, "good") for i in range(30)] + [(100 + i, "short", "bad") for i in range(30)] + [(200, doubtful, "good"), (201, doubtful, "bad"), (202, fine, "bad")]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == {*range(30), 200, 202}


def test_mixing(docs, empty):
    weights = {r["key"]: r["m"] for r in mixing.source_weights(docs).collect()}
    plan = mixing.frame_slots(mixing.source_weights(docs)).collect()
    want = brute.mixed_slots(weights)
    assert [k for _, k in sorted((s, r["key"]) for r in plan for s in r["slots"])] == want
    w = len(want)
    for t in range(1, w + 1):
        for k, m in weights.items():
            assert abs(want[:t].count(k) - t * m / w) < 1
    mixed = mixing.mix_sources(docs, block_rows=2).collect()
    assert len(mixed) == docs.count()
    for key in {r["source"] for r in mixed}:
        rows = sorted(r["mix_row"] for r in mixed if r["source"] == key)
        assert rows == list(range(len(rows)))
    assert len({(r["mix_slot"], r["mix_block_row"]) for r in mixed}) == len(mixed)
    ordered = mixing.in_mixed_order(docs, block_rows=2)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_order_is_kept_with_uneven_weights(spark):
    weights = spark.createDataFrame([("=a", 7), ("=b", 2), ("=c", 1)], "key string, m long")
    plan = mixing.frame_slots(weights).collect()
    assert [k for _, k in sorted((s, r["key"]) for r in plan for s in r["slots"])] == brute.mixed_slots({"=a": 7, "=b": 2, "=c": 1})


def test_rules(spark, docs, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(120)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:40]] + [" | ".join(t.split()) for t in good[40:80]]
    rows = [(i, t, int(i < 120)) for i, t in enumerate(good + bad)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.classify(d, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert held and sum(p == y for p, y in held) / len(held) > 0.95
    x, y = rules.training_rows(d, labels)
    model = rules.fit(x, y)
    assert 0 < len(model.rules) < 200
    out = rules.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert rules.score(empty, model).count() == 0
    assert rules.classify(docs, labels.filter("false")).count() == docs.count()


def plain_posteriors(scores, transitions):
    t, e = np.exp(transitions), np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-9
    a, b = np.empty(e.shape), np.ones(e.shape)
    a[0] = e[0] / e[0].sum()
    for i in range(1, len(e)):
        a[i] = (a[i - 1] @ t) * e[i]
        a[i] /= a[i].sum()
    for i in range(len(e) - 2, -1, -1):
        b[i] = t @ (b[i + 1] * e[i + 1])
        b[i] /= b[i].sum()
    return a * b / (a * b).sum(axis=1, keepdims=True)


def test_forward_backward_in_blocks():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 0, 127, 128, 129, 700, 3])
    scores, transitions = rng.normal(size=(sizes.sum(), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    got, at = language.posteriors(scores, sizes, transitions), 0
    for n in sizes[sizes > 0]:
        assert np.allclose(got[at : at + n], plain_posteriors(scores[at : at + n].astype(float), transitions.astype(float)), atol=1e-4)
        at += n


def test_language(spark, docs, empty):
    rng = random.Random(8)
    own = {"en": "the and thion wher ing".split(), "de": "der und schen keit ung".split(), "fr": "le une eau ment çon".split()}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) + rng.choice(["", ",", "."]) for _ in range(n))
    rows = [(i, say(lang := ("en", "de", "fr")[i % 3], 30), lang) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(d, sample_rows=200).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]
    assert held and np.mean(held) > 0.95
    model = language.fit([(t, lang) for _, t, lang in rows])
    mixed = spark.createDataFrame([(1, say("en", 40) + " " + say("de", 60)), (2, None), (3, "12 - !"), (4, "")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in language.predict(mixed, model).collect()}
    assert (r[1]["lang_pred"], r[1]["n_switches"] >= 1) == ("de", True)
    assert [r[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert language.predict(docs, model).count() == docs.count()
    assert language.predict(empty, model).count() == 0
    assert language.identify(empty).count() == 0


def test_pieces(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, ref = pieces.piece_model(path), sentencepiece.SentencePieceProcessor(model_file=path)

    def same(text):
        ids = ref.encode(text, add_bos=True, add_eos=True)
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert own.decode(got) == ref.decode(ids), text

    rng = random.Random(1)
    for _ in range(1500):
        same("".join(rng.choice(" \n\t▁aeiouthnds éü語😀\x00 <>s/0x0A   ") for _ in range(rng.randint(0, 40))))
        same("".join(own.pieces[rng.randrange(259, 32000)] for _ in range(rng.randint(1, 6))))
    same("ab" * 5000 + " " * 70)
    rows = pieces.encode_texts(docs, path).collect()
    assert len(rows) == docs.count()
    by_id = dict(collected(docs))
    assert all(r["decoded"] == ref.decode(ref.encode(by_id[r["doc_id"]] or "")) for r in rows)
    assert pieces.encode_texts(empty, path).count() == 0


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi", None, None, None, None), (1, 1, "assistant", None, "a", "add", '{"x":1,"y":2}', None), (1, 2, "assistant", None, "b", "add", '{"x":"1"}', None),
        (1, 3, "tool", "3", None, None, None, "b"), (1, 4, "tool", "4", None, None, None, "a"), (1, 5, "tool", "?", None, None, None, "nobody"), (1, 6, "assistant", 'q"\n', "c", "other", "[1]", None),
        (2, 0, "tool", "x", None, None, None, "a"), (None, 0, "user", None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "conv long, turn long, role string, text string, call_id string, tool string, arguments string, result_of string")
    schema = {"add": {"required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer", "maximum": 5}}}}
    out = chat.link_tool_calls(m, schema).collect()
    assert len(out) == len(rows)
    first = sorted((r for r in out if r["conv"] == 1), key=lambda r: (r["seq_turn"], r["seq_level"], r["seq_kind"], r["turn"]))
    assert [r["turn"] for r in first] == [0, 1, 4, 2, 3, 5, 6]
    assert {r["turn"]: r["linked"] for r in first} == {0: None, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    assert {r["turn"]: r["errors"] for r in first if r["valid"] is not None} == {1: "", 2: "x: not integer; y: missing", 6: "unknown tool"}
    assert next(r["json"] for r in first if r["turn"] == 1) == '{"role":"assistant","tool_call":{"arguments":{"x":1,"y":2},"id":"a","name":"add"}}'
    needs = spark.createDataFrame([(1, "a", "b"), (1, "c", "a")], "conv long, call string, needed string")
    levels = {r["turn"]: (r["seq_turn"], r["seq_level"]) for r in chat.link_tool_calls(m, schema, needs).filter("conv = 1 and valid is not null").collect()}
    assert levels == {1: (2, 1), 2: (2, 0), 6: (6, 2)}
    loop = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "conv long, call string, needed string")
    chat.MOST_LEVELS, most = 4, chat.MOST_LEVELS
    with pytest.raises(ValueError, match="cycle"):
        chat.link_tool_calls(m, schema, loop)
    chat.MOST_LEVELS = most
    assert chat.link_tool_calls(m.filter("false"), schema).count() == 0


def test_id_and_text_columns_may_have_any_name(docs):
    other = docs.select(F.col("doc_id").alias("text"), F.col("text").alias("doc_id"))
    got = map_texts(other, lambda t: {"size": [len(x) for x in t]}, "size long", id_col="text", text_col="doc_id")
    assert got.columns == ["text", "size"] and got.count() == docs.count()


def test_contract_columns():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
