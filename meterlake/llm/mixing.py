"""Operator 6: mixing sources to target weights by Pfair scheduling (native columns only).

Documents of a source are shuffled by the MD5 of their id and cut into blocks. With integer
weights m that sum to W, the j-th block of a source in a frame of W slots may not start
before its release floor(j W / m) and must be placed before its deadline
ceil((j + 1) W / m). Earliest deadline first fills the slots; as the weights sum to W every
window is met, so after any number of slots a source is less than one block away from its
share. Frames repeat. Slots of a source that has run out stay empty: the others follow in the
same order, and every document is placed exactly once.

The schedule of a large frame is worked out by halves (`frame_places`): which jobs run in a range
of slots, then in which half of it, down to single slots. It is the schedule that taking one slot
after another gives.

Weights are the given targets, rounded to a frame of whole slots. The frame grows with the
number of sources, so the shares that rounding and the least weight of one slot move are at
most one slot of the frame for a source, and a twentieth of the whole for all together.

Row numbers within a source come from counts per (source, MD5 prefix) and running sums over
those, so a source with a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Sources x slots up to which a frame is folded in one row; beyond, its slots are dealt by halves over many tasks, with the same result.
FOLD_STEPS = 50_000
#: Slots of a frame for each source, at least.
SLOTS_PER_SOURCE = 20
_BUCKET_ROWS = 2_000


def target_weights(targets: DataFrame, *, source_col: str = "source", weight_col: str = "weight", frame: int = 1000) -> DataFrame:
    """(key, m): targets (source, weight > 0), one row for each source, as integers of about `frame` slots in all, at least 1.

    No or a negative weight, and a source named twice, are errors.
    """
    rows = targets.select(_key(source_col).alias("key"), F.col(weight_col).cast("double").alias("w"))
    n, different, bad, total = rows.agg(F.count("*"), F.countDistinct("key"), F.count_if(F.col("w").isNull() | F.isnan("w") | (F.col("w") <= 0)), F.sum("w")).first()
    if bad or different < n:
        raise ValueError("every source needs one weight above 0")
    size = max(frame, SLOTS_PER_SOURCE * n)
    return rows.select("key", F.greatest(F.lit(1), F.round(size * F.col("w") / F.lit(total or 1.0))).cast("long").alias("m"))


def source_weights(docs: DataFrame, *, source_col: str = "source", temperature: float = 0.5, frame: int = 1000) -> DataFrame:
    """(key, m): weights rows ** temperature of the sources that are there."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    return target_weights(counts.select("source", F.pow("n", F.lit(temperature)).alias("weight")), frame=frame)


def _key(source_col: str) -> Column:
    """Text key of a source; a null source is a source of its own."""
    return F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


def frame_slots(weights: DataFrame) -> DataFrame:
    """(key, m, w, slots array<int>): slots of a frame of w = sum(m) slots by earliest deadline first, ties by key."""
    row = weights.agg(F.array_sort(F.collect_list(F.struct("key", "m"))).alias("s"))
    row = row.select("s", F.transform("s", lambda x: x["m"]).alias("m"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["m"]).alias("w"))
    picked = F.expr("""
        aggregate(
          sequence(0L, w - 1),
          named_struct('next', transform(m, x -> 0L), 'slots', cast(array() as array<int>)),
          (acc, t) -> transform(
            array(array_min(transform(m, (x, i) -> if(acc.next[i] < x and (acc.next[i] * w) div x <= t,
              named_struct('deadline', ((acc.next[i] + 1) * w + x - 1) div x, 'i', i), null)))),
            pick -> named_struct(
              'next', transform(acc.next, (x, i) -> if(i = pick.i, x + 1, x)),
              'slots', concat(acc.slots, array(pick.i))))[0],
          acc -> acc.slots)
    """)
    slots = row.filter(F.size("s") > 0).select("s", "w", picked.alias("picked")).select("s", "w", F.posexplode("picked").alias("slot", "i"))
    found = slots.groupBy("i", "w", F.get("s", F.col("i")).alias("x")).agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    return found.select("x.key", "x.m", "w", "slots")


#: Ranges of up to 2 ** 10 slots are dealt within one partition.
_LOCAL = 10


def frame_places(weights: DataFrame) -> DataFrame:
    """(key, j, slot): the slot of the j-th block of each source, the schedule of `frame_slots` for frames of any size.

    Slots are the leaves of a binary tree. Going up, a job (one block of a source) is `used` in a
    node if it would run there with no jobs handed over from earlier slots: of the jobs used in the
    right half and those that the left half had no slot for, the earliest deadlines get the right
    half's slots. Going down, the jobs of a node are dealt to its halves: the left one takes the
    earliest deadlines of those released before the node or used in the left half, the right one
    takes the rest. A job is one narrow row, and each level ranks them within nodes; below _LOCAL
    levels all nodes of a partition are ranked without a shuffle. No weights give no rows.
    """
    w = weights.agg(F.sum("m")).first()[0] or 0
    height = max(w - 1, 0).bit_length()
    jobs = weights.select("key", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    release, deadline = F.expr(f"j * {w}L div m"), F.expr(f"((j + 1) * {w}L + m - 1) div m")
    jobs = jobs.select("key", "j", release.alias("release"), deadline.alias("deadline"))

    def rank(*node: str) -> Column:
        return F.row_number().over(Window.partitionBy(*node).orderBy("deadline", "key"))

    def size(start: Column, level: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1 << level), F.lit(w) - start))

    # bit l of `used`: the job runs in its own node of 2 ** l slots without jobs handed over
    rows = jobs.withColumn("part", F.shiftright("release", _LOCAL)).repartition("part")
    rows = rows.withColumn("used", (rank("part", "release") == 1).cast("long"))
    for level in range(height):
        if level >= _LOCAL:
            rows = rows.withColumn("part", F.shiftright("release", level + 1))
        right = F.shiftright("release", level).bitwiseAND(1)
        was = F.shiftright("used", level).bitwiseAND(1)
        rows = rows.withColumns({"node": F.shiftright("release", level + 1), "open": right == was})
        start = F.shiftleft("node", level + 1) + (1 << level)
        now = F.when(F.col("open"), (rank("part", "node", "open") <= size(start, level)).cast("long")).otherwise(was)
        rows = rows.withColumn("used", F.col("used").bitwiseOR(F.shiftleft(now, level + 1)))
    rows = rows.withColumn("slot", F.lit(0).cast("long"))
    for level in reversed(range(height)):
        if level >= _LOCAL:
            rows = rows.withColumn("part", F.col("slot"))
        elif level == _LOCAL - 1:
            rows = rows.withColumn("part", F.col("slot")).repartition("part")
        start = F.shiftleft("slot", level + 1)
        own = (F.shiftright("release", level) == 2 * F.col("slot")) & (F.shiftright("used", level).bitwiseAND(1) == 1)
        rows = rows.withColumn("open", (F.col("release") < start) | own)
        left = F.col("open") & (rank("part", "slot", "open") <= size(start, level))
        rows = rows.withColumn("slot", 2 * F.col("slot") + F.when(left, 0).otherwise(1))
    return rows.select("key", "j", "slot")


def _placed(docs: DataFrame, weights: DataFrame | None, block_rows: int, frame: int, temperature: float, id_col: str, source_col: str) -> DataFrame:
    """(doc, mix_row, mix_block, mix_slot, mix_block_row): `doc` is the whole row, so its columns may have any name."""
    weights = weights if weights is not None else source_weights(docs, source_col=source_col, temperature=temperature, frame=frame)
    sources, frame_size = weights.agg(F.count("*"), F.sum("m")).first()
    small = sources * (frame_size or 0) <= FOLD_STEPS
    plan = frame_slots(weights) if small else checkpointed(weights.select("key", "m", F.lit(frame_size).alias("w")))
    rows = docs.select(F.col(id_col).alias("id"), _key(source_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).join(plan.select("key", "m"), "key", "left").agg(F.sum("n").alias("n"), F.count_if(F.col("m").isNull()).alias("unknown")).first()
    if counts["unknown"]:
        raise ValueError(f"{counts['unknown']} sources have no weight")
    total, digits = counts["n"] or 0, 1
    while total > _BUCKET_ROWS * 16**digits:
        digits += 1
    no_id = F.concat(F.lit("!"), F.md5(F.xxhash64("doc").cast("string")))
    hashed = F.coalesce(F.md5(F.col("id").cast("string")), no_id)
    bucket = F.substring(hashed, F.lit(1), F.when(F.col("id").isNull(), digits + 1).otherwise(digits))
    marked = rows.select("doc", "id", "key", hashed.alias("md5"), bucket.alias("bucket"))
    sizes = rows.select("key", bucket.alias("bucket")).groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(plan, "key")
    within = Window.partitionBy("key", "bucket").orderBy("md5", "id")
    placed = marked.withColumn("n", F.row_number().over(within)).join(starts, ["key", "bucket"])
    row = F.col("start") + F.col("n") - 1
    placed = placed.withColumns({"mix_row": row.cast("long"), "mix_block": F.floor(row / block_rows).cast("long"), "mix_block_row": (row % block_rows).cast("long")})
    if small:
        slot = F.expr("mix_block div m * w + element_at(slots, cast(mix_block % m as int) + 1)")
    else:
        places = checkpointed(frame_places(plan)).withColumnRenamed("slot", "place")
        placed, slot = placed.withColumn("j", F.expr("mix_block % m")).join(places, ["key", "j"]), F.expr("mix_block div m * w + place")
    return placed.select("doc", "mix_row", "mix_block", slot.cast("long").alias("mix_slot"), "mix_block_row")


_PLACES = ("mix_row", "mix_block", "mix_slot", "mix_block_row")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, block_rows: int = 64, frame: int = 1000, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` with mix_row, mix_block, mix_slot, mix_block_row (long): all rows, each once.

    weights: (key, m) as `target_weights` or `source_weights` makes them, one row for each
    source; a source of the documents without one is an error. Order within a source is by MD5
    of the id, then id; rows without an id come first, by a hash of all their columns, so they
    don't meet in one task; repeated rows are placed one after another in any order. Columns of
    `docs` with the four names are replaced, others may have any name. Empty input gives no rows.
    """
    placed = _placed(docs.drop(*_PLACES), weights, block_rows, frame, temperature, id_col, source_col)
    return placed.select("doc.*", *_PLACES)


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None, *, block_rows: int = 64, frame: int = 1000, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents in the order of their slots, with the columns of `docs` as they are; every row stays, repeated ones too."""
    placed = _placed(docs, weights, block_rows, frame, temperature, id_col, source_col)
    return placed.repartitionByRange("mix_slot", "mix_block_row").sortWithinPartitions("mix_slot", "mix_block_row").select("doc.*")
