"""Operator 2: SimHash near-duplicates by anchor-point covering.

Fingerprints (64 bits) link when they differ in at most two bits. Split a fingerprint into
halves; two linked ones agree to within one bit in at least one half. On 31 bits of each
half the perfect Hamming code [31, 26] serves as the set of anchors: its covering radius is
1, so every half has one *home* anchor at distance 0 or 1, and a partner that differs in one
bit (the threshold left to the half) lies within 2 of that anchor. Each distinct fingerprint
is therefore replicated to every anchor within radius + threshold = 2 (16 per half, 1 where
the half is itself an anchor) and each anchor compares its home members with its replicas.

Where many different fingerprints crowd at an anchor (more than `dense_at`), its members
change to the finest code, in which every 64-bit value is an anchor with covering radius 0:
a member goes to the 65 values within one bit. Two fingerprints within two bits share such a
value, and at most 65 fingerprints can, so no bucket grows with the data. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_above, let_go, map_texts, spread_join

SEED = 42
_CHUNK = 1 << 16
#: Bits 0..30 are covered; position i + 1 of the Hamming code is bit i.
MASK31 = 0x7FFFFFFF


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, ASCII-lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    hashed, spans = xxhash.xxh64_intdigest, zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return majority(np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - last))


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of shingle hashes, repeats included: a bit is 1 if it is set in over half of them; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every whole text; null and empty texts give 0."""

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        return {"fp": [fingerprint(t, width) for t in texts]}

    return map_texts(docs, work, "fp long", id_col=id_col, text_col=text_col)


def _syndrome(half: Column) -> Column:
    """XOR of the positions (1..31) of the set bits: 0 for a code word, else the bit to flip."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out = out + F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << k)
    return out.cast("int")


def anchors(rows: DataFrame) -> DataFrame:
    """`rows` with home_anchor, the anchor within one bit of their column half (31 bits), and near, all others within two bits."""
    flip = "shiftleft(1L, {} - 1)"
    near = F.expr(f"transform(filter(sequence(1, 31), i -> (i ^ s) > i), i -> half ^ {flip.format('i')} ^ {flip.format('(i ^ s)')})")
    home = F.when(F.col("s") == 0, F.col("half")).otherwise(F.expr("half ^ shiftleft(1L, s - 1)"))
    return rows.withColumn("s", _syndrome(F.col("half"))).withColumns({"home_anchor": home, "near": near}).drop("s")


def _replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, fp, home): each fingerprint at the anchors within radius + threshold, in both halves."""
    halves = distinct.select(
        "fp",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(F.lit(MASK31)).alias("half")),
            F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(MASK31)).alias("half")),
        )).alias("h"),
    ).select("fp", "h.side", "h.half")
    parts = anchors(halves).select("fp", "side", "home_anchor", F.explode(F.concat(F.array("home_anchor"), "near")).alias("a"))
    return parts.select((F.col("a") * 2 + F.col("side")).alias("anchor"), "fp", (F.col("a") == F.col("home_anchor")).alias("home"))


def links(distinct: DataFrame, *, dense_at: int = 128) -> DataFrame:
    """(a, b), a > b: links that connect all fingerprints at two or fewer differing bits.

    `distinct` has one row per fingerprint (column fp). Pairs at ordinary anchors come out
    as they are; within dense anchors each member is tied to the smallest one of its
    65-value neighbourhood, which gives the same components without listing all pairs.
    """
    replicas = _replicas(distinct)
    dense = checkpointed(replicas.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > dense_at).select("anchor"))
    crowded = not dense.isEmpty()
    sparse = replicas.join(dense, "anchor", "left_anti") if crowded else replicas
    homes = sparse.filter("home").select("anchor", F.col("fp").alias("x"))
    pairs = homes.join(sparse.select("anchor", F.col("fp").alias("y")), "anchor").filter((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2))
    found = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    if crowded:
        members = replicas.join(dense, "anchor", "left_semi").select("fp").distinct()
        spots = members.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("spot"))
        least = spots.groupBy("spot").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("spot", "b")
        found = found.union(spots.join(least, "spot").filter("fp != b").select(F.col("fp").alias("a"), "b"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), by alternating large-star and small-star steps.

    Root is the smallest node. Minima are taken by partial aggregates and joined back; the
    edges of a hub are dealt over many tasks for that. Each round is checkpointed.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())

    def mark(e: DataFrame) -> tuple:
        """Number of edges, sum of their hashes, most edges of a smaller end."""
        ends = e.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return tuple(ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.max("n")).first())

    before = mark(now)
    while before[0]:
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        upper = both.filter("b > a")
        # a root has the edges to all of its component; the larger end of an edge has few to smaller ones
        hub = before[2] > hot_above(before[0])
        large = spread_join(upper, checkpointed(low, before[0]), "a", now.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n"))) if hub else upper.join(low, "a")
        large = checkpointed(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), before[0])
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(low.select("a", F.col("m").alias("b")))
        now = checkpointed(small.distinct(), 2 * before[0])
        let_go(edges.sparkSession)
        after = mark(now)
        if after[:2] == before[:2]:
            break
        before = after
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, *, width: int = 3, dense_at: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): component is the smallest id reachable over links.

    Texts without words (null, empty, blank) have fingerprint 0 and link like any other.
    Repeated rows come out once each. A null id takes part but never names a component
    unless all its members have null ids. Empty input gives no rows.
    """
    marked = checkpointed(fingerprints(docs, width=width, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("id"), "fp"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), dense_at=dense_at)).withColumnRenamed("node", "fp")
    tied = checkpointed(roots.join(distinct.select("fp", "rep"), "fp"))
    least = tied.groupBy("root").agg(F.min("rep").alias("lowest"), F.count("*").alias("n"))
    named = spread_join(tied, least.drop("n"), "root", least).select("fp", "lowest")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("lowest", "rep").alias("component"))
    return spread_join(marked, named, "fp", distinct).select(F.col("id").alias(id_col), "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id names their component, one row per id; columns as given.

    A document without an id can't name a group and is kept.
    """
    found = near_duplicates(docs, **options)
    kept = found.filter(F.col("doc_id") == F.col("component")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
