"""Operator 12: prefix trie of conversations that are rebuilt from the head of another and a tail of their own.

A sequence of turns has a fingerprint from a monoid: a turn is a number t, a sequence (n, v)
with v = sum of t_i r^(n - i) modulo the prime 2^127 - 1, and (n, v)(m, w) = (n + m, v r^m + w).
Prefixes of the original conversations are fingerprinted once. A rebuilt prefix is a base
head, then own turns h + 1 to k: its fingerprint is V(k) + (B - V(h)) r^(k - h), with B that
of the head, so no rebuilt text is ever made and all of a conversation shares one difference.

Nodes are groups of equal depth and fingerprint. Members of a node must agree on their last
turn, which is looked up by reference; as two equal fingerprints with the same last turn have
equal fingerprints before it, agreement at every node shows that groups are equal turn by
turn. If any group disagrees, everything is done again with another r.

A conversation owns the nodes of which it is the smallest member: those from some depth s to
its end. So sums over a subtree need no walk: each member of a node adds what it owns, or
shares, below, which follows from s and running word counts alone.

Long conversations are cut into blocks of a range partitioning; each block keeps products of
its own, and the products before it are composed from one row per block and carried in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpointed, spread_join, stored

PRIME = (1 << 127) - 1
#: Multipliers of the fingerprints, by attempt.
_ATTEMPTS = 4
#: Longest head that a plan may ask for: heads are kept as columns.
MOST_HEADS = 8
#: Ids of a chunk that is hashed as one piece.
_CHUNK = 4_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_M64 = (1 << 64) - 1
Value = tuple[int, int]  # (turns, value)


def multiplier(attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(b"r%d" % attempt).digest()[:16], "big") % PRIME


def compose(left: Value, right: Value, r: int) -> Value:
    """Product of two sequences: the turns of one, then those of the other."""
    return left[0] + right[0], (left[1] * pow(r, right[0], PRIME) + right[1]) % PRIME


@lru_cache(maxsize=100_000)
def _power(r: int, n: int) -> int:
    return pow(r, n, PRIME)


def turn_value(digest: bytes) -> int:
    return int.from_bytes(digest[:16], "big") % PRIME


def _split(v: int) -> Value:
    """A value as two signed 64-bit numbers."""
    low = v & _M64
    return v >> 64, low - (1 << 64) if low >> 63 else low


def _whole(high: int, low: int) -> int:
    return high << 64 | low & _M64


def digest_of(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: length of the role, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _map(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], fields: str) -> DataFrame:
    """`work` over the rows of a partition, batch by batch."""
    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in work(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)


_SCANNED = "conv long, block int, last boolean, k long, high long, low long, p_high long, p_low long, t_high long, t_low long, words long, before long"


def _positions(turns: DataFrame, r: int) -> DataFrame:
    """(conv, k, high, low, p_high, p_low, t_high, t_low, words, before): turns in order, numbered from 1, with the fingerprint
    of the prefix that ends here, that of the one before, the turn's value, its words, and those of the turns before."""
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest", "row"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")

    def scan(rows: Iterator[dict]) -> Iterator[dict]:
        """Products within the block. A summary (k = 0) follows for the first and the last conversation, which others may share."""
        block = TaskContext.get().partitionId()
        conv, k, v, seen, runs = None, 0, 0, 0, 0

        def summary(last: bool) -> dict:
            high, low = _split(v)
            return {"conv": conv, "block": block, "last": last, "k": 0, "high": high, "low": low, "words": k, "before": seen}

        for row in rows:
            if row["conv"] != conv:
                if runs == 1:
                    yield summary(False)
                conv, k, v, seen, runs = row["conv"], 0, 0, 0, runs + 1
            t, (p_high, p_low) = turn_value(row["digest"]), _split(v)
            k, v = k + 1, (v * r + t) % PRIME
            high, low = _split(v)
            t_high, t_low = _split(t)
            yield {"conv": conv, "block": block, "k": k, "high": high, "low": low, "p_high": p_high, "p_low": p_low, "t_high": t_high, "t_low": t_low, "words": row["words"], "before": seen}
            seen += row["words"]
        if runs:
            yield summary(True)

    scanned = stored(_map(ranged, scan, _SCANNED), "turns")
    ends = StructType.fromDDL("conv long, block int, n0 long, v_high long, v_low long, w0 long")
    arrow = to_arrow_schema(ends)

    def carried(table: pa.Table) -> pa.Table:
        """Products of all earlier blocks of a conversation, for each of its blocks: two rows a block at most."""
        out, so_far, words = [], (0, 0), 0
        for row in sorted(table.to_pylist(), key=lambda x: x["block"]):
            high, low = _split(so_far[1])
            out.append({"conv": row["conv"], "block": row["block"], "n0": so_far[0], "v_high": high, "v_low": low, "w0": words})
            so_far = compose(so_far, (row["words"], _whole(row["high"], row["low"])), r)
            words += row["before"]
        return pa.Table.from_pylist(out, schema=arrow)

    # at most two rows per block
    carry = scanned.filter("k = 0").select("conv", "block", "high", "low", "words", "before").groupBy("conv").applyInArrow(carried, ends).filter("n0 > 0")
    joined = scanned.filter("k > 0").join(F.broadcast(carry), ["conv", "block"], "left")

    def continued(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            if row["n0"]:
                ahead = (row["n0"], _whole(row["v_high"], row["v_low"]))
                k = row["k"]
                _, v = compose(ahead, (k, _whole(row["high"], row["low"])), r)
                _, p = compose(ahead, (k - 1, _whole(row["p_high"], row["p_low"])), r)
                row["high"], row["low"] = _split(v)
                row["p_high"], row["p_low"] = _split(p)
                row["k"], row["before"] = k + row["n0"], row["before"] + row["w0"]
            yield {c: row[c] for c in _PLACED}

    return stored(_map(joined, continued, "conv long, k long, high long, low long, p_high long, p_low long, t_high long, t_low long, words long, before long"), "placed")


_PLACED = ("conv", "k", "high", "low", "p_high", "p_low", "t_high", "t_low", "words", "before")


def _plans(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation of the plan: own turns n, heads wanted and had, its length when rebuilt, what to add to its own fingerprints and word counts, and the head's rows."""
    of_head = F.struct("k", "high", "low", "p_high", "p_low", "t_high", "t_low", "words", "before")
    heads = placed.filter(F.col("k") <= MOST_HEADS).groupBy("conv").agg(F.array_sort(F.collect_list(of_head)).alias("head"))
    own = placed.groupBy("conv").agg(F.max("k").alias("n")).join(heads, "conv")
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    rows = plan.join(own, "conv", "left").join(base, "base", "left")
    n, had = F.coalesce("n", F.lit(0)), F.least("heads", F.coalesce("base_n", F.lit(0))).cast("int")
    row_at = lambda head, at, field: F.when(at > 0, F.get(F.col(head), at - 1)[field])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    skipped = F.least(F.col("heads"), n).cast("int")
    through = lambda head, at: zero(row_at(head, at, "before")) + zero(row_at(head, at, "words"))
    return rows.select(
        "conv", "base", "heads", n.alias("n"), had.alias("had"), (had + F.greatest(n - F.col("heads"), F.lit(0))).alias("length"),
        zero(row_at("base_head", had, "high")).alias("b_high"), zero(row_at("base_head", had, "low")).alias("b_low"),
        zero(row_at("head", skipped, "high")).alias("h_high"), zero(row_at("head", skipped, "low")).alias("h_low"),
        (through("base_head", had) - through("head", skipped)).alias("more_words"),
        F.when(had > 0, F.slice("base_head", 1, had)).alias("head"),
    )


_MEMBER = ("conv", "depth", "length", "high", "low", "p_high", "p_low", "t_high", "t_low", "words", "before")


def _members(placed: DataFrame, plans: DataFrame, counts: DataFrame, r: int) -> DataFrame:
    """A row for each depth of each rebuilt conversation, 0 included."""
    tails = spread_join(placed, plans.drop("head", "base", "n"), "conv", counts).filter(F.col("k") > F.col("heads"))

    def rebuilt(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            apart, past = _whole(row["b_high"], row["b_low"]) - _whole(row["h_high"], row["h_low"]), row["k"] - row["heads"]
            high, low = _split((_whole(row["high"], row["low"]) + apart * _power(r, past)) % PRIME)
            p_high, p_low = _split((_whole(row["p_high"], row["p_low"]) + apart * _power(r, past - 1)) % PRIME)
            yield {
                "conv": row["conv"], "depth": row["had"] + past, "length": row["length"], "high": high, "low": low, "p_high": p_high, "p_low": p_low,
                "t_high": row["t_high"], "t_low": row["t_low"], "words": row["words"], "before": row["before"] + row["more_words"],
            }

    own = _map(tails, rebuilt, "conv long, depth long, length long, high long, low long, p_high long, p_low long, t_high long, t_low long, words long, before long")
    headed = plans.select("conv", "length", F.explode("head").alias("x"))
    headed = headed.select("conv", F.col("x.k").alias("depth"), "length", *[F.col(f"x.{c}").alias(c) for c in _MEMBER[3:]])
    roots = plans.select("conv", F.lit(0).cast("long").alias("depth"), "length", *[F.lit(0).cast("long").alias(c) for c in _MEMBER[3:]])
    return own.select(*_MEMBER).unionByName(headed.select(*_MEMBER)).unionByName(roots.select(*_MEMBER))


def _ends(members: DataFrame) -> DataFrame:
    """(depth, high, low, ends_sha256): SHA-256 of the ids that end at a node, in order.

    Ids are sorted by range, so those of a node may stand in several partitions; each joins its
    stretch to chunks, and one task feeds the chunks of a node to the hash, a chunk at a time.
    """
    node = ["depth", "high", "low"]
    ids = members.filter("depth = length").select(*node, "conv").repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv")

    def chunks(rows: Iterator[dict]) -> Iterator[dict]:
        block, key, held, n = TaskContext.get().partitionId(), None, [], 0
        for row in rows:
            at = (row["depth"], row["high"], row["low"])
            if held and (at != key or len(held) >= _CHUNK):
                yield dict(zip(node, key, strict=True)) | {"block": block, "n": n, "ids": ",".join(held)}
                held, n = [], n + 1
            key = at
            held.append(str(row["conv"]))
        if held:
            yield dict(zip(node, key, strict=True)) | {"block": block, "n": n, "ids": ",".join(held)}

    fields = "depth long, high long, low long"
    cut = _map(ids, chunks, f"{fields}, block int, n int, ids string")

    def hashed(rows: Iterator[dict]) -> Iterator[dict]:
        key, sha = None, None
        for row in rows:
            at = (row["depth"], row["high"], row["low"])
            if at != key:
                if sha:
                    yield dict(zip(node, key, strict=True)) | {"ends_sha256": sha.hexdigest()}
                key, sha = at, hashlib.sha256()
                sha.update(row["ids"].encode())
            else:
                sha.update(b"," + row["ids"].encode())
        if sha:
            yield dict(zip(node, key, strict=True)) | {"ends_sha256": sha.hexdigest()}

    return _map(cut.repartition(*node).sortWithinPartitions(*node, "block", "n"), hashed, f"{fields}, ends_sha256 string")


def prefix_trie(turns: DataFrame, plan: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_index.

    plan: (conv, base, heads), one row per rebuilt conversation, heads from 0 to MOST_HEADS:
    the first `heads` turns of conversation `base` (all if fewer, none if absent), then the
    conversation's own turns after its first `heads`. turn_conv and turn_index say where the
    node's last turn stands in the original conversations; both are null at the root.

    Turns are ordered by turn, null first, ties by role, then by SHA-256 of the turn; repeated
    rows are turns of their own. Null role and text count as empty. Rows without a conversation
    belong to none; further columns may have any name. An empty plan gives no rows, not even a
    root. Words are runs of other characters than blanks and \\t to \\r.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")).cast("long")
    narrow = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest_of(role, text).alias("digest"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    node = ["depth", "high", "low"]
    for attempt in range(_ATTEMPTS):
        r = multiplier(attempt)
        placed = _positions(narrow, r)
        plans = stored(_plans(placed, plan), "plans")
        members = stored(_members(placed, plans, plans.select("conv", "n"), r), "members")
        nodes = stored(
            members.groupBy(*node).agg(
                F.min("conv").alias("owner"), F.max("length").alias("longest"), F.min("before").alias("before"),
                *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("t_high", "t_low")],
            ),
            "nodes",
        )
        if nodes.filter("min_t_high <> max_t_high or min_t_low <> max_t_low").isEmpty():
            break
    else:
        raise ValueError("fingerprints of different turns fall together with every multiplier")

    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("first"), F.min_by("before", "depth").alias("shared_words"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    tops = members.join(owned.select("conv", F.col("first").alias("depth")), ["conv", "depth"]).filter("depth > 0")
    tops = tops.select("conv", F.struct((F.col("depth") - 1).alias("depth"), F.col("p_high").alias("high"), F.col("p_low").alias("low")).alias("node"))
    above = spread_join(tops, nodes.select(F.struct(*node).alias("node"), F.col("owner").alias("above")), "node", tops.groupBy("node").agg(F.count("*").alias("n"))).select("conv", "above")
    whole = members.filter("depth = length").select("conv", (F.col("before") + F.col("words")).alias("all_words"))
    # one that owns nothing shares all its words
    shares = plans.select("conv", "base", "heads", "had", "length").join(owned, "conv", "left").join(above, "conv", "left").join(whole, "conv")
    shares = shares.select("conv", "base", "heads", "had", F.coalesce("first", F.col("length") + 1).alias("first"), F.coalesce("shared_words", "all_words").alias("shared_words"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "above")
    rows = spread_join(members, checkpointed(shares), "conv", plans.select("conv", (F.col("length") + 1).alias("n")))
    depth, mine = F.col("depth"), F.col("first") <= F.col("depth")
    in_head = depth <= F.col("had")
    last = F.when(depth > 0, F.struct(F.when(in_head, F.col("base")).otherwise(F.col("conv")).alias("conv"), F.when(in_head, depth).otherwise(depth - F.col("had") + F.col("heads")).alias("index")))
    found = rows.groupBy(*node).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(mine & (depth > 0), F.when(depth > F.col("first"), F.col("conv")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("first") <= depth + 1) & (depth < F.col("length"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(mine, F.lit(0)).otherwise(F.col("shared_words") - F.col("before"))).alias("saved_tokens"),
        F.max(F.when(mine, last)).alias("last"),
    )
    named = found.join(_ends(members), node, "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        F.col("last.conv").alias("turn_conv"), F.col("last.index").alias("turn_index"),
    )


def head_plan(turns: DataFrame, *, every: int = 20, most: int = 4, conv_col: str = "conv_id") -> DataFrame:
    """(conv, base, heads) for `prefix_trie`: each conversation starts with the head of the one at the last multiple of `every`, of crc32(id) % most turns."""
    conv = F.col(conv_col).cast("long")
    ids = turns.filter(F.col(conv_col).isNotNull()).select(conv.alias("conv")).distinct()
    return ids.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("heads"))
