"""Near duplicates of the pipeline: all documents linked whose word shingles have a Jaccard similarity of 0.8 or more.

The method is op2's, anchor-point covering of Hamming fingerprints (`simhash.py`), with exact
checks of the pairs it finds. Texts with the same set of shingles are one node.

1. SimHash fingerprints of the shingles at two or fewer differing bits, by op2's anchors.
2. A SimHash gives no bound for a Jaccard similarity, so the covering goes on with long
   fingerprints that do. Shingles are dealt by their hash over the segments of a set, and each
   segment has 31 bits: the parity of its shingles at each bit. Two sets of similarity t, the
   smaller one of n shingles, differ in at most D = n (1 - t) / t shingles. 16 segments are a
   block; of D / 32 + 1 blocks one differs in at most 31 shingles, and in one of its segments
   in at most one, hence in at most one bit. Segments go to the anchors of the Hamming code
   [31, 26] within radius 1 + threshold 1, and home members are compared with replicas there,
   by the bits of the block, which differ in no more than its share of what the sets may. A row carries the segments of its
   block, so a pair is made at the first segment of a block that it meets at, and not at the others. The number of segments follows from the power of two above the size;
   a set that a smaller one of the class below can match is dealt for that class as well. No link is lost.

A document that no other one can match takes no part in that. Anchors of the finest code (every
value an anchor, radius 0) show which: shingles are dealt over some more segments than two sets
can differ in shingles, D, so a set shares all of its segments that hold shingles but D with any
set that it links to, value by value. Only the values go through the shuffle, packed by bucket,
and come back where several sets hold them. A value stands for all shingles of a segment, so words
that many documents have in common by chance don't add up with the size of the corpus. Once
components are known, only values that two of them hold count, so documents whose links are all
found drop out before the next step.

A large group of near copies meets at the same anchors with all its members. Members are first
checked against one home member of an anchor, at a few segments of each block, and only pairs in
different components are listed after that, at all segments, so a group isn't compared with
itself pair by pair, and the links that are found join components, not members. Nothing is capped.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, let_go, map_texts, removed, spread_join, stored, text_slices
from .simhash import anchors, components

SEED = 42
_WORDS = 8
_EPS = 1e-9
#: Up to so many ids are broadcast.
_BROADCAST = 200_000
#: Values of segments that meet in one bucket, at most about; the least number of buckets.
_MET, _BUCKETS = 1_000_000, 96
#: Least sizes of the classes of sets by which segments are dealt to leave documents out: steps of a quarter.
_CLASSES = np.array(reduce(lambda found, _: [*found, max(found[-1] + 1, found[-1] * 5 // 4)], range(90), [1]))
#: Segments j of a block at which a turn checks against one member of an anchor.
_TURNS = ("j % 8 = 0", "j % 4 = 1")
#: Replicas of segments that are joined at once, as long as that takes no more than so many slices.
_SLICE, _SLICES = 5_000_000, 16
#: Segments of a block, and the 64-bit words that hold them, two in each.
_BLOCK, _CHECK = 16, 8
_WORD = [f"w{i}" for i in range(_CHECK)]


def _shingles(text: bytes, width: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the word shingles of a text, ASCII-lower-cased, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the shingles of a text, each once."""
    return np.unique(_shingles(text, width)).view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _bitmap(shingles: np.ndarray) -> list[int]:
    odd = np.bincount((shingles.view(np.uint64) >> np.uint64(32)).astype(np.int64) % (64 * _WORDS), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _apart(size: int, threshold: float) -> int:
    """In how many shingles a set of less than 2**size and a larger one can differ."""
    return int(((1 << size) - 1) * (1 - threshold) / threshold + _EPS)


def _segments(shingles: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(segment, half, *words): the number of each segment with its class, its 31 bits, and all those of its block of segments."""
    n, h = len(shingles), shingles.view(np.uint64)
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * (2 + _CHECK)]
    for size in {n.bit_length(), int(np.ceil(threshold * n - _EPS)).bit_length()} if n else ():
        apart = _apart(size, threshold)
        many = apart // 2 + 1 if apart < 2 * _BLOCK else (apart // (2 * _BLOCK) + 1) * _BLOCK
        at = (h % np.uint64(many)).astype(np.int64)
        half = np.zeros(-(-many // _BLOCK) * _BLOCK, np.uint64)
        np.bitwise_xor.at(half, at, np.uint64(1) << (h >> np.uint64(24)) % np.uint64(31))
        words = (half[::2] | half[1::2] << np.uint64(32)).view(np.int64).reshape(-1, _CHECK)
        part = np.arange(many, dtype=np.int64)
        found.append(((size << 26) + part, half[:many].view(np.int64), *words[part // _BLOCK].T))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(shingles: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(block, lanes, *words): the number of the first segment of each block, how many it has, and their bits."""
    segment, _, *words = _segments(shingles, threshold)
    first = np.flatnonzero(segment % _BLOCK == 0)
    return segment[first], np.diff(np.append(first, len(segment))), *(w[first] for w in words)


def _values(shingles: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Values of all segments that hold shingles, in each class, and how many of them a set shares at least with one it links to.

    A link's smaller set is in one of the classes from the least size that the threshold allows to
    the set's own. At 0 or less nothing can be told from the values.
    """
    n, h = len(shingles), shingles.view(np.uint64)
    found, need = [np.empty(0, np.uint64)], [] if n else [1]
    low, high = np.searchsorted(_CLASSES, [int(np.ceil(threshold * n - _EPS)), n], side="right")
    for size in range(low, high + 1) if n else ():
        apart = int((_CLASSES[size] - 1) * (1 - threshold) / threshold + _EPS)
        many = apart + apart * 3 // 8 + 4 if apart else 1
        at = (h % np.uint64(many)).astype(np.int64)
        sums = np.zeros(many, np.uint64)
        np.add.at(sums, at, h)
        part = np.flatnonzero(np.bincount(at, minlength=many))
        value = (sums[part] ^ ((np.uint64(size) << np.uint64(32)) + part.astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
        found.append(value ^ value >> np.uint64(29))
        need.append(len(part) - apart)
    return np.concatenate(found), min(need)


def _packed(values: np.ndarray, buckets: int, **ends: np.ndarray) -> pa.RecordBatch:
    """A row (bucket, key, *ends) for each bucket: arrays of the values there and of the other columns."""
    bucket = (values % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    offsets = pa.array(np.append(starts, len(order)), pa.int32())
    key = ((values // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    columns = {"bucket": pa.array(bucket[order][starts])} | {k: pa.ListArray.from_arrays(offsets, pa.array(x[order])) for k, x in ({"key": key} | ends).items()}
    return pa.RecordBatch.from_pydict(columns)


def _several(rows: pa.Table, buckets: int) -> pa.Table:
    """(node, shared): the values of each node in a bucket that several roots hold, each once; a node is its own root if there is no root."""
    key, node, root = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("key", "node", "root" if "root" in rows.column_names else "node"))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(key) else order
    order = order[np.lexsort((root[order], key[order]))]
    first = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] - 1)) if len(order) else order
    sizes = np.diff(np.append(first, len(order)))
    order = order[np.repeat(root[order[first]] != root[order[first + sizes - 1]], sizes)]
    order = order[np.lexsort((key[order], node[order]))]
    node, key = node[order], key[order]
    new = np.append(True, node[1:] != node[:-1]) if len(node) else np.empty(0, bool)
    once = new | np.append(True, key[1:] != key[:-1]) if len(node) else new
    node, key, new = node[once], key[once], np.flatnonzero(new[once])
    shared = key.view(np.uint32).astype(np.int64) * buckets + int(rows.column("bucket")[0].as_py())
    return pa.table({"node": node[new], "shared": pa.ListArray.from_arrays(pa.array(np.append(new, len(node)), pa.int32()), pa.array(shared))})


def _buckets(df: DataFrame, values: int) -> int:
    """Buckets for so many values: one for each shuffle partition at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _BUCKETS, values // _MET + 1)


def _shared(posted: DataFrame, buckets: int) -> DataFrame:
    """(node, shared): rows for each bucket, of the packed rows `posted`."""

    def run(rows: pa.Table) -> pa.Table:
        # what the last bucket took isn't needed in this one
        pa.default_memory_pool().release_unused()
        return _several(rows, buckets)

    return posted.groupBy("bucket").applyInArrow(run, "node long, shared array<long>")


def _posted(docs: DataFrame, threshold: float, width: int, buckets: int, text_col: str) -> DataFrame:
    """(bucket, key array, node array) of whole texts; a set that a batch holds again isn't posted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_slices(batches):
            sets = {_node(s): s for s in (shingle_set(t or b"", width) for t in texts.to_pylist())}
            values = [_values(s, threshold)[0] for s in sets.values()]
            yield _packed(np.concatenate(values), buckets, node=np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(v) for v in values]))
            del sets, values
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket int, key array<int>, node array<long>")


def _may_be(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and bitmaps of the sides a and b leave room for the threshold."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(_WORDS)])
    return (F.least(n, m) >= F.greatest(n, m) * threshold - _EPS) & (apart <= (n + m) * ((1 - threshold) / (1 + threshold)) + _EPS)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= _BROADCAST else df


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    pairs = pairs.distinct()
    sides = sets.select("node", "n", "bits")
    near = pairs.join(sides.alias("x"), F.col("a") == F.col("x.node")).join(sides.alias("y"), F.col("b") == F.col("y.node"))
    near = checkpointed(near.filter(_may_be("x", "y", threshold)).select("a", "b"))
    both = near
    whole = sets.join(_small(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    for end in "ab":
        both = spread_join(both, whole.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")), end, near.groupBy(end).agg(F.count("*").alias("n")))
    same = F.size(F.array_intersect("sa", "sb"))
    found = checkpointed(both.filter(same >= (F.size("sa") + F.size("sb") - same) * threshold - _EPS).select("a", "b"))
    let_go(pairs.sparkSession)
    return found


def _joined(own: DataFrame, links: DataFrame) -> DataFrame:
    """own (node, root) after links (a, b) between nodes have joined components."""
    left, right = own.select(F.col("node").alias("a"), F.col("root").alias("ra")), own.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    many = own.count()
    edges = checkpointed(links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), many)
    if edges.isEmpty():
        return own
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    counts = own.groupBy("root").agg(F.count("*").alias("n"))
    keyed = counts.select("root").join(moved, "root", "left").select("root", F.coalesce("to", "root").alias("to"))
    now = checkpointed(spread_join(own, keyed, "root", counts).select("node", F.col("to").alias("root")), many)
    let_go(links.sparkSession)
    return now


def _printed(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that SimHash links: each with the smallest one of its fingerprint, and those of linked fingerprints."""
    least = checkpointed(prints.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), prints.count())
    near = simhash.links(least.select("fp"))
    x, y = least.select(F.col("fp").alias("a"), F.col("least").alias("x")), least.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    same = spread_join(prints, least.filter("n > 1").select("fp", "least"), "fp", least.select("fp", "n")).filter("node <> least")
    return near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).union(same.select(F.col("least").alias("a"), F.col("node").alias("b")))


def _open(close: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of own (node, root) that can have a link to another component: as many values of their segments as a link needs are in several components."""
    buckets = _buckets(own, close.agg(F.sum(F.size("shared"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = batch.column("shared").flatten().to_numpy(), pc.list_value_length(batch.column("shared")).to_numpy()
            yield _packed(values.view(np.uint64), buckets, **{c: np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "root")})

    held = close.select("node", "shared").join(_small(own), "node").select("node", "root", "shared")
    posted = held.mapInArrow(run, "bucket int, key array<int>, node array<long>, root array<long>")
    left = _shared(posted, buckets).groupBy("node").agg(F.sum(F.size("shared")).alias("k"))
    found = own.join(close.select("node", "need"), "node").join(left, "node", "left")
    found = checkpointed(found.filter(F.coalesce("k", F.lit(0)) >= F.col("need")).select("node", "root"), own.count())
    let_go(close.sparkSession)
    return found


def _placed(sets: DataFrame, some: DataFrame, lanes: str = "true") -> DataFrame:
    """(node, n, root, block, *words, segment, half, home_anchor, near): segments of the sets of some (node, root), those at the places j of their blocks for which `lanes` holds, with their anchors."""
    blocks = sets.select("node", "n", "block", "lanes", *_WORD).join(_small(some), "node")
    blocks = blocks.select("node", "n", "root", F.inline(F.arrays_zip("block", "lanes", *_WORD)))
    half = f"shiftrightunsigned(element_at(array({', '.join(_WORD)}), cast(j div 2 as int) + 1), cast(j % 2 * 32 as int)) & {simhash.MASK31}L"
    parts = F.expr(f"inline(transform(filter(sequence(0, lanes - 1), j -> {lanes}), j -> struct(block + j as segment, {half} as half)))")
    return anchors(blocks.select("node", "n", "root", *_WORD, parts))


def _anchor(a: str) -> Column:
    return F.col("segment") * (1 << 31) + F.col(a)


def _few(threshold: float) -> Column:
    """Whether sizes and blocks of the sides x and y at one anchor leave room for the threshold: the block that differs least has a block's share of what differs at most.

    The class is that of the smaller set; sets that are dealt for two classes meet in the other one as well.
    """
    apart = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in _WORD)
    blocks = f"(floor(floor((shiftleft(1L, cast(shiftright(x.anchor, 57) as int)) - 1) * {(1 - threshold) / threshold!r}D + {_EPS!r}D) / {2 * _BLOCK}) + 1)"
    sizes = F.expr(f"least(x.n, y.n) >= greatest(x.n, y.n) * {threshold!r}D - {_EPS!r}D and shiftright(least(x.n, y.n), cast(shiftright(x.anchor, 57) as int) - 1) = 1")
    return sizes & F.expr(f"({apart}) * {blocks} <= (x.n + y.n) * {(1 - threshold) / (1 + threshold)!r}D + {_EPS!r}D")


def _first() -> Column:
    """Whether no earlier segment of their block has the sides x and y within one bit, so that they are a pair at this one."""
    bits = "bit_count(shiftrightunsigned(x.{w} ^ y.{w}, {by}) & {mask}L) > 1"
    earlier = [f"(x.segment % {_BLOCK} <= {j} or " + bits.format(w=_WORD[j // 2], by=32 * (j % 2), mask=simhash.MASK31) + ")" for j in range(_BLOCK - 1)]
    return F.expr(" and ".join(earlier))


def _at_pivots(sets: DataFrame, some: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (a, b) in different components: a home member of an anchor with one of its home members, in every turn another and at other segments."""
    homes = _placed(sets, some, _TURNS[turn]).select(_anchor("home_anchor").alias("anchor"), "node", "n", "root", *_WORD)
    by = F.xxhash64("node", F.lit(turn)) if turn == 0 else F.xxhash64("node", "anchor", F.lit(turn))
    pivots = homes.groupBy("anchor").agg(F.min_by(F.struct("node", "n", "root", *_WORD), by).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    x, y = homes.alias("x"), pivots.select("anchor", "p.*").alias("y")
    met = x.join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.root") != F.col("y.root")) & _few(threshold)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    # at first one partner a node: most groups are whole after that
    return met.groupBy("b").agg(F.min_by("a", F.xxhash64("a", F.lit(turn))).alias("a")).select("a", "b") if turn == 0 else met.distinct()


def _pairs(sets: DataFrame, some: DataFrame, threshold: float, lanes: str = "true") -> DataFrame:
    """(a, b): pairs in different components of a home member of an anchor and a replica there within one bit, each once in every block of its class that is close enough."""
    rows = _placed(sets, some, lanes)
    homes = rows.select(_anchor("home_anchor").alias("anchor"), "segment", "node", "n", "root", *_WORD).alias("x")
    replicas = rows.select("segment", "node", "n", "root", *_WORD, F.explode(F.concat(F.array("home_anchor"), "near")).alias("a")).select(_anchor("a").alias("anchor"), "node", "n", "root", *_WORD).alias("y")
    # either side of a pair has a replica at the home of the other
    met = homes.join(replicas, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _few(threshold) & _first())
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _at_anchors(sets: DataFrame, some: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of `some` that meet at an anchor within one bit."""
    total = sets.join(_small(some), "node", "left_semi").agg(F.sum(F.expr("aggregate(lanes, 0L, (a, n) -> a + n)"))).first()[0] or 0
    slices, found = min(_SLICES, 1 + total * 16 // _SLICE), []
    for i in range(slices):
        found.append(checkpointed(_pairs(sets, some, threshold, f"j % {slices} = {i}").distinct()))
        let_go(sets.sparkSession)
    return reduce(DataFrame.union, found)


def similar_groups(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): component is the smallest id reachable over links, for every row with an id.

    Texts without words link to each other. Repeated rows come out once each. Empty input
    gives no rows.
    """
    if threshold < 0.5:
        raise ValueError("bitmaps of sets more than twice as large as each other aren't comparable: threshold 0.5 at least")
    docs = docs.filter(F.col(id_col).isNotNull())

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        every = [_shingles(t, width) for t in texts]
        sets = [np.unique(h).view(np.int64) for h in every]
        return {"node": [_node(s) for s in sets], "n": [len(s) for s in sets], "fp": [simhash.majority(h) for h in every], "need": [_values(s, threshold)[1] for s in sets]}

    marked = checkpointed(map_texts(docs, work, "node long, n int, fp long, need int", id_col=id_col, text_col=text_col))
    rows, shingles = marked.agg(F.count("*"), F.sum("n")).first()
    # rows of a node have the same shingles, so the same segments; fingerprints may differ by repeats
    nodes = checkpointed(marked.groupBy("node").agg(F.min(id_col).alias("rep"), F.count("*").alias("rows"), F.min("fp").alias("fp"), F.first("need").alias("need")), rows)
    buckets = _buckets(docs, shingles or 0)
    met = _shared(_posted(docs, threshold, width, buckets, text_col), buckets).groupBy("node").agg(F.flatten(F.collect_list("shared")).alias("shared"))
    close = nodes.join(met, "node", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))
    close = checkpointed(close.filter(F.size("shared") >= F.col("need")).select("node", "rep", "fp", "need", "shared"))
    close = close.coalesce(4 + close.count() // 20_000)
    del met
    gc.collect()
    let_go(docs.sparkSession)

    def cut(texts: Sequence[bytes]) -> dict[str, Sequence]:
        sets = [shingle_set(t, width) for t in texts]
        parts = [_blocks(s, threshold) for s in sets]
        return {"node": [_node(s) for s in sets], "n": [len(s) for s in sets], "s": sets, "bits": [_bitmap(s) for s in sets], "block": [p[0] for p in parts], "lanes": [p[1] for p in parts], **{w: [p[2 + i] for p in parts] for i, w in enumerate(_WORD)}}

    texts = docs.select(id_col, text_col).join(_small(close.select(F.col("rep").alias(id_col)).distinct()), id_col, "left_semi")
    sets = map_texts(texts, cut, "node long, n int, s array<long>, bits array<long>, block array<long>, lanes array<int>, " + ", ".join(f"{w} array<long>" for w in _WORD), id_col=id_col, text_col=text_col)
    sets = stored(sets.drop(id_col).join(_small(close.select("node")), "node", "left_semi"), "shingle_sets")
    if sets.count() > sets.select("node").distinct().count():
        # an id stands in several rows
        sets, twice = stored(sets.dropDuplicates(["node"]), "shingle_sets"), sets
        removed(twice)
    let_go(docs.sparkSession)

    own = close.select("node", F.col("node").alias("root"))
    own = _joined(own, _verified(_printed(close.select("node", "fp")), sets, threshold))
    for turn in range(len(_TURNS)):
        own = _joined(own, _verified(_at_pivots(sets, _open(close, own), threshold, turn), sets, threshold))
    own = _joined(own, _verified(_at_anchors(sets, _open(close, own), threshold), sets, threshold))

    tied = checkpointed(own.join(close.select("node", "rep"), "node"))
    removed(sets)
    del sets, close, own
    gc.collect()
    let_go(docs.sparkSession)
    least = tied.groupBy("root").agg(F.min("rep").alias("lowest"), F.count("*").alias("n"))
    named = spread_join(tied, least.drop("n"), "root", least).select("node", "lowest")
    named = nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("lowest", "rep").alias("component"))
    return spread_join(marked.select(id_col, "node"), named, "node", nodes.select("node", F.col("rows").alias("n"))).select(id_col, "component")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id names their group, one row per id; columns as given. Those without an id stay."""
    kept = similar_groups(docs, **options).filter(F.col("doc_id") == F.col("component")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
