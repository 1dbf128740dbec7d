"""Near duplicates of the pipeline against all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from meterlake.llm import simhash, similar


def all_pairs(rows, least=0.8):
    """id -> smallest id reachable over pairs of the least Jaccard similarity of 5-word shingles."""
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= least * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in parent}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [[word() for _ in range(rng.randint(3, 200))] for _ in range(25)]
    made = [list(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 5):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            made.append(copy)
    # one group of near copies of which most, not all, reach the threshold, and a passage that all others hold too
    group = [word() for _ in range(100)]
    for _ in range(60):
        copy = list(group)
        for _ in range(rng.choice((1, 1, 2))):
            copy[rng.randrange(100)] = word()
        made.append(copy)
    made += [group[:30] + [word() for _ in range(n)] for n in range(1, 40)]
    texts = [" ".join(t) for t in made]
    texts += [texts[0].upper(), texts[5], "", None, " \n", "one", "one two", "one"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_all_pairs_of_the_threshold_are_found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = all_pairs(rows)
    assert {r["doc_id"]: r["component"] for r in similar.similar_groups(docs).collect()} == want
    more = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "no id")], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, more, "")
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda d: -1 if d is None else d) == [None, *sorted(set(want.values()))]
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_sets_within_the_threshold_meet_at_a_segment():
    """One block differs in no more than its share, and one of its segments in at most one bit."""
    rng = np.random.default_rng(4)
    ones = lambda x: bin(x % 2**64).count("1")
    tried = 0
    for _ in range(3000):
        n = int(2 ** rng.uniform(0, 9))
        made = rng.integers(-(2**63), 2**63, 2 * n)
        gone, new = (int(rng.integers(0, n // 4 + 1)) for _ in range(2))
        if n - gone < 0.8 * (n + new):
            continue
        tried += 1
        x, y = ({k: (half, words) for k, half, *words in zip(*(c.tolist() for c in similar._segments(np.sort(s), 0.8)), strict=True)} for s in (made[:n], made[gone : n + new]))
        met = [k for k in x.keys() & y.keys() if ones(x[k][0] ^ y[k][0]) <= 1]
        share = lambda k: (n + n - gone + new) / 9 / (similar._apart(k >> 26, 0.8) // 32 + 1)
        assert any(sum(ones(a ^ b) for a, b in zip(x[k][1], y[k][1], strict=True)) <= share(k) + 1e-9 for k in met)
    assert tried > 500


def test_links_within_a_large_group_are_not_listed_pair_by_pair(spark, monkeypatch):
    """Copies link that share one of their two edits: the pairs are many times the members, what components are made of is not."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = [" ".join([*base[:20], f"a{i}", *base[21:70], f"b{j}", *base[71:]]) for i in range(15) for j in range(8)]
    rows, seen, real = list(enumerate(texts)), [], similar.components
    monkeypatch.setattr(similar, "components", lambda edges: seen.append(edges.count()) or real(edges))
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component"] for r in got.collect()} == all_pairs(rows) == dict.fromkeys(range(120), 0)
    assert sum(seen) <= 2 * len(rows)


def test_candidates_come_from_simhash_anchors(spark, monkeypatch, rows):
    """Without pairs from op2's anchors there are no links but equal sets."""
    monkeypatch.setattr(similar, "anchors", lambda rows: simhash.anchors(rows).filter("false"))
    monkeypatch.setattr(simhash, "links", lambda prints: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = {similar._node(similar.shingle_set((t or "").encode())) for _, t in rows}
    assert similar.similar_groups(docs).select("component").distinct().count() == len(nodes)


def _sets(spark, every):
    """The table of sets that `similar` stores, of (node, shingles)."""
    cut = [(node, len(s), *(x.tolist() for x in similar._blocks(np.sort(s), 0.8))) for node, s in every]
    return spark.createDataFrame(cut, "node long, n int, block array<long>, lanes array<int>, " + ", ".join(f"{w} array<long>" for w in similar._WORD))


def test_a_pair_is_made_at_one_segment_of_a_block(spark):
    """A near copy shares most of its segments; that makes it one row a block, and all pairs within the threshold are made."""
    rng = np.random.default_rng(8)
    every, blocks = [], {}
    for n in (1, 2, 9, 70, 110, 150, 300):
        base = rng.integers(-(2**63), 2**63, n)
        for gone in (0, 1, n // 24, n // 11):
            every.append((len(every), np.concatenate((base[gone:], rng.integers(-(2**63), 2**63, gone)))))
            blocks[len(every) - 1] = n
    near = {(a, b) for a, x in every for b, y in every if a < b and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    own = spark.createDataFrame([(a, a) for a, _ in every], "node long, root long")
    made = [tuple(r) for r in similar._pairs(_sets(spark, every), own, 0.8).collect()]
    assert near - {p for p in near if np.array_equal(np.sort(every[p[0]][1]), np.sort(every[p[1]][1]))} <= set(made) and len(near) > 20
    assert all(made.count(p) <= similar._apart(blocks[p[0]].bit_length(), 0.8) // 32 + 1 for p in made)


def test_documents_whose_links_are_found_drop_out(spark):
    close = spark.createDataFrame([(1, 2, [10, 11, 12]), (2, 2, [10, 11]), (3, 1, [12]), (4, 1, [13]), (5, 1, [13])], "node long, need int, shared array<long>")
    left = lambda roots: sorted(r["node"] for r in similar._open(close, spark.createDataFrame(list(roots.items()), "node long, root long")).collect())
    assert left({1: 1, 2: 2, 3: 3, 4: 4, 5: 5}) == [1, 2, 3, 4, 5]
    assert left({1: 1, 2: 1, 3: 3, 4: 4, 5: 4}) == [3]
    assert left({1: 1, 2: 1, 3: 1, 4: 4, 5: 4}) == []


def test_stored_sets_are_gone_when_groups_are_known(spark, rows, monkeypatch):
    written, real = [], similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, name: written.append(real(df, name)) or written[-1])
    found = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(written) == 1 and written[0].inputFiles()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        written[0].collect()
    assert found.count() == len(rows)


def test_a_link_shares_as_many_values_of_segments_as_it_needs():
    """Segments that hold no shingles don't count: sets of one length without a common shingle share none."""
    rng = np.random.default_rng(6)
    tried = 0
    for _ in range(2000):
        n = int(2 ** rng.uniform(0, 10))
        made = rng.integers(-(2**63), 2**63, 2 * n)
        gone, new = (int(rng.integers(0, n // 4 + 1)) for _ in range(2))
        (x, need_x), (y, need_y), (other, _) = (similar._values(np.sort(s), 0.8) for s in (made[:n], made[gone : n + new], rng.integers(-(2**63), 2**63, n)))
        assert not len(np.intersect1d(x, other))
        if n - gone >= 0.8 * (n + new):
            tried += 1
            assert len(np.intersect1d(x, y)) >= max(need_x, need_y)
    assert tried > 500


def test_passages_shared_with_many_documents_keep_none_of_them_in_question(spark, monkeypatch):
    """Every shingle of these documents but those across passages is in another one, each passage in a different one; none link."""
    rng = random.Random(5)
    passages = {(i, k): " ".join(f"w{rng.randrange(9000)}" for _ in range(20)) for i in range(40) for k in range(4)}
    texts = [" ".join([passages[i, k] for k in range(4)] + [passages[(i + 3 * k + 1) % 40, k] for k in range(4)]) for i in range(40)]
    rows, seen, real = list(enumerate(texts)), [], similar._printed
    monkeypatch.setattr(similar, "_printed", lambda prints: seen.append(prints.count()) or real(prints))
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component"] for r in got.collect()} == all_pairs(rows) == {i: i for i in range(40)}
    assert seen == [0]
