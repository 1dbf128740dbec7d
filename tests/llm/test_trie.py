"""Operator 12: the prefix trie against plain Python, on odd, tied, repeated and long conversations."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from meterlake.llm import queries, trie
from meterlake.llm.oracle import ORACLE_SQL
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, plan=None):
    """Nodes by plain Python. rows: (conv, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())
            own.setdefault(c, []).append((key, (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    plan = plan or {c: (c - c % 20 if c >= 0 else c + (-c) % 20, zlib.crc32(str(c).encode()) % 4) for c in own}
    built = {c: own.get(b, [])[:h] + own.get(c, [])[h:] for c, (b, h) in plan.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * words(p)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs=45, most=7, letters="abc"):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c * rng.choice((1, 1, 3)), rng.choice((t, t, t, None, 0)), rng.choice(("user", "assistant", None)), rng.choice((*letters, "two words", None, ""))))
    return rows


def stored_rows(spark, rows, path):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in ("conv", "k", "digest", "depth", "node", "high")})
    d.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


ODD = [(None, 1, "user", "nobody"), (5, None, None, None), (5, None, None, None), (5, 2, "user", "x " * 5000), (6, 1, "user", "a"), (7, 1, "user", "a"), (20, 1, "user", "a"), (21, 0, "", "a"), (-3, 1, "user", "a"), (40, 1, "user:", "a"), (60, 1, "user", ":a")]


@pytest.mark.parametrize("rows", [made(1), made(2, convs=60, most=3, letters="a"), ODD, []], ids=["many", "alike", "odd", "none"])
def test_op12(spark, tmp_path, rows):
    folder = stored_rows(spark, rows, tmp_path)
    got = queries.op12_prefix_trie(spark, folder)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op12_prefix_trie']}) x").fetchall(), key=str) == brute(rows)


def test_one_long_conversation_over_many_blocks(spark):
    """One conversation with most rows, read in many ranges; copies of it share all nodes."""
    rows = [(20, t, "user", f"w{t % 7} " * (t % 3)) for t in range(400)] + [(33, t, "user", f"w{t % 7} " * (t % 3)) for t in range(300)] + made(3, convs=15)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = trie.prefix_trie(turns, trie.head_plan(turns)).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_own_plan_and_references(spark):
    """Heads longer than the base, absent bases, and conversations without turns; references lead to the node's turn."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    plan = {1: (1, 2), 2: (1, 1), 3: (1, 5), 4: (9, 2), 5: (2, 0), 6: (2, 3)}
    turns = spark.createDataFrame(rows, SCHEMA)
    given = spark.createDataFrame([(c, b, h) for c, (b, h) in plan.items()], "conv long, base long, heads int")
    got = trie.prefix_trie(turns, given).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows, plan)
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role, text))
    built = {c: own.get(b, [])[:h] + own.get(c, [])[h:] for c, (b, h) in plan.items()}
    for r in got:
        turn = own[r["turn_conv"]][r["turn_index"] - 1] if r["depth"] else None
        assert turn == (built[r["conv_id"]][r["depth"] - 1] if r["depth"] else None)


def test_products_are_associative():
    rng = random.Random(1)
    r = trie.multiplier(0)
    for _ in range(50):
        a, b, c = ((rng.randint(0, 9), rng.randrange(trie.PRIME)) for _ in range(3))
        assert trie.compose(trie.compose(a, b, r), c, r) == trie.compose(a, trie.compose(b, c, r), r)
        assert trie.compose((0, 0), a, r) == a == trie.compose(a, (0, 0), r)


def test_collisions_change_the_multiplier(spark, monkeypatch):
    """A multiplier of 0 makes every fingerprint that of the last turn: groups disagree no more, but r = 1 lets orders fall together."""
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a")]
    turns = spark.createDataFrame(rows, SCHEMA)
    given = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "conv long, base long, heads int")
    good = trie.multiplier
    monkeypatch.setattr(trie, "multiplier", lambda n: 1 if n == 0 else good(n))
    got = trie.prefix_trie(turns, given).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, {1: (1, 0), 2: (2, 0)})
    monkeypatch.setattr(trie, "multiplier", lambda n: 1)
    with pytest.raises(ValueError):
        trie.prefix_trie(turns, given)
