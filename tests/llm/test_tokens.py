"""Operators 11 and 13: byte-level BPE and token alignment against the libraries and brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from meterlake.llm import align, byte_bpe, queries
from pyspark.sql import functions as F
from test_operators import texts
from tokenizers import Tokenizer

PATTERN = public_tokenizers.PATTERN
RANKS, JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["x" * 3000, " " * 2000 + "end", "a  b \n\n c\t\td ", "it's we'll 'S", "\x1c \x1d\x85 \xa0x　y", "12½ ²Ⅷ٣", "▁ already ▁▁marked", "<|endoftext|> <s></s> <0x41>", "é" * 70 + "🙂" * 50, "\x00\x01 nul", "﻿ bom​", " "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tokens")
    made = [(i, t, "en", "s", 1, "x") for i, t in enumerate([*texts(), *ODD])]
    rows = [*made, made[3], (None, "no id", None, None, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id__ string").withColumns({"at": F.lit(1), "block": F.lit("b"), "pairs": F.lit(0)}).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{path}/documents.parquet").filter("false").write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_ranks_of_both_files_agree():
    with open(RANKS, "rb") as f:
        want = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert byte_bpe.read_ranks(RANKS) == want == byte_bpe.read_json(JSON)


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 7, 3000):
        keys = [f"key {i}".encode() for i in range(n)]
        table = byte_bpe.PerfectHash(keys)
        assert sorted(table._slots.tolist()) == list(range(n))
        if n:
            assert table.find(keys).tolist() == list(range(n))


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        byte_bpe.ByteModel({b"a": 0}, PATTERN)


@pytest.mark.parametrize("file", [RANKS, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])
def test_random_texts(file):
    rng = random.Random(4)
    model = byte_bpe.ByteModel(byte_bpe.read_ranks(file), PATTERN)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    letters = "aabbthe   \n\t\r\x1c\x85'sd1½²漢🙂!.,é​\x00 "
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(2000)] + ODD
    for text, ids in zip(cases, model.encode_all(cases), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text), text
        assert model.decode(ids) == text.encode()


def test_both_tiers_merge_alike(library):
    rng = random.Random(5)
    model = byte_bpe.byte_model(RANKS, PATTERN)
    words = [bytes(rng.choice(b"aabbcthe ") for _ in range(rng.randint(1, 40))) for _ in range(500)] + [b"a" * 63, bytes(range(64))]
    for word, ids in zip(words, model.merge_many(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.merge(word)
    assert model.whole([b" the", b"qqqqqq", b"a"]).tolist() == [model.ranks[b" the"], -1, model.ranks[b"a"]]
    assert model.merge_many([]) == [] and model.whole([]).tolist() == []


def test_memory_of_pieces_turns_over(library):
    model = byte_bpe.ByteModel(byte_bpe.read_ranks(RANKS), PATTERN, memo=3)
    for text in texts() * 2:
        assert np.frombuffer(model.encode_all([text or ""])[0], "<u4").tolist() == library.encode_ordinary(text or "")


def test_op11(spark, folder, library):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = queries.op11_byte_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(want)
    assert queries.op11_byte_bpe(spark, f"{folder}/none").count() == 0
    whole = byte_bpe.encode_texts(spark.read.parquet(f"{folder}/documents.parquet"), RANKS, PATTERN).collect()
    assert all(library.encode_ordinary((r["decoded"] or b"").decode()) == np.frombuffer(r["ids"], "<u4").tolist() for r in whole)


def brute(docs):
    """Per document by plain Python: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a_model = Tokenizer.from_file(JSON)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokens = {i: t for t, i in byte_bpe.read_json(JSON).items()}

    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(size(i))))
            at += len(size(i))
        return out

    found = []
    for d, text in docs:
        a, b = [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            if not b"".join(tokens[i] for i in a) == b"".join(b_bytes(i) for i in b) == (" " + text).encode():
                a, b = [], []
        a, b = spans(a, tokens.__getitem__), spans(b, b_bytes)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 500 else [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, start = [], 0
        for cut in cuts:
            side = lambda x: ",".join(str(i) for i, _, e in x if start < e <= cut)  # noqa: B023, E731
            parts.append(f"{side(a)}|{side(b)}")
            start = cut
        found.append((d, len(a), len(b), len(cuts), links, ";".join(parts)))
    held = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(d, na, nb, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text) for d, na, nb, g, links, text in found], held, best


def test_op13(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, held, best = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = queries.op13_token_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    hashed = [(*row[:7], hashlib.sha256(row[7].encode()).hexdigest() if row[7] else "") for row in want]
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(hashed)
    assert queries.op13_token_alignment(spark, f"{folder}/none").count() == 0
    pairs = align.pair_counts(docs, JSON, PATTERN, PIECES).collect()
    assert {(r["a"], r["b"]): (r["docs"], r["best"]) for r in pairs} == {p: (n, n == best[p[0]]) for p, n in held.items()}
    # many small slices and blocks, and groups as text
    monkeypatch.setattr(align, "SLICE_BYTES", 200)
    monkeypatch.setattr(align, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(align, "_PAIRS_ROW", 7)
    shown = align.align_tokenizers(docs, JSON, PATTERN, PIECES, with_groups=True).drop("groups_sha256").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted_rows(map(tuple, shown.collect())) == sorted_rows(want)


def test_texts_without_alignment(spark):
    docs = spark.createDataFrame([(1, "a ▁ b"), (2, ""), (3, None)], "doc_id long, text string")
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in align.align_tokenizers(docs, JSON, PATTERN, PIECES).collect())
