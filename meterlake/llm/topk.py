"""Operator 4: exact top-k search by exhaustive term-at-a-time accumulation.

A component is a term, its quantised value a weight. Rows are packed into blocks of postings:
for each term the rows that have it, with their weights. Each block of queries meets each
block of candidates once, in one cell of a grid of query parts and candidate parts: a block is
copied along one side of the grid only. In a pair of blocks the terms are taken one at a time:
the postings of the term, times the weights of the queries that have it, are added into a
dense array of scores. The best k of a row are found by
partition selection, ties cut by the smaller id, and partial lists are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

QUERY_BLOCK, CANDIDATE_BLOCK = 256, 1024
#: At most so many cells of the grid.
MOST_CELLS = 4096
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NONE = _LOW


def quantised(vectors: DataFrame, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, copy int, v array<double>): floor(scale * x) of each component, whole numbers.

    Vectors that are null or hold a null or non-finite component are left out, as are null
    ids. `copy` numbers rows with the same id.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), usable.alias("ok")).filter("id is not null and x is not null and ok")
    copies = F.row_number().over(Window.partitionBy("id").orderBy("x")) - 1
    return rows.select("id", copies.alias("copy"), F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("double")).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of a partition: ids and copies, and the postings by term (ends, rows, weights), as binary."""
    names = ("ids", "copies", "ends", "rows", "weights")
    schema = ", ".join(f"{n} binary" for n in names)
    arrow = pa.schema([(n, pa.binary()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = part.column("v").to_pylist()
                width = max(map(len, vectors), default=0)
                dense = np.zeros((len(vectors), width))
                for k, v in enumerate(vectors):
                    dense[k, : len(v)] = v
                ids, copies = (part.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("id", "<i8"), ("copy", "<i4")))
                ends, at_rows, weights = postings(dense)
                cells = (ids, copies, ends.astype("<i4"), at_rows.astype("<i4"), weights.astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], schema=arrow)

    return rows.mapInArrow(run, schema)


#: Postings of a block: end of each term's stretch, then the rows and weights of all stretches.
Postings = tuple[np.ndarray, np.ndarray, np.ndarray]


def postings(dense: np.ndarray) -> Postings:
    """Postings by term of rows of whole numbers; zeros are left out."""
    terms, rows = np.nonzero(dense.T)
    return np.cumsum(np.bincount(terms, minlength=dense.shape[1])), rows, dense[rows, terms]


def _exact(a: np.ndarray, b: np.ndarray, terms: int) -> bool:
    """Whether no sum of `terms` products of the weights can leave 64 bits."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(terms, 1) < 2.0**62


def scatter(queries: Postings, n_queries: int, candidates: Postings, n_candidates: int) -> np.ndarray:
    """Scores (queries x candidates), term by term; beyond 64 bits they stop at its ends."""
    (q_ends, q_rows, q_weights), (ends, rows, weights) = queries, candidates
    terms = min(len(q_ends), len(ends))
    exact = _exact(q_weights, weights, terms)
    whole = (lambda w: w.astype(np.int64)) if exact else np.vectorize(int, otypes=[object])
    q_weights, weights = (whole(w) if len(w) else w.astype(np.int64) for w in (q_weights, weights))
    scores = np.zeros((n_queries, n_candidates), np.int64 if exact else object)
    q_from = at = 0
    for q_to, to in zip(q_ends[:terms].tolist(), ends[:terms].tolist(), strict=True):
        if q_to > q_from and to > at:
            weighted = np.multiply.outer(q_weights[q_from:q_to], weights[at:to])
            if q_to - q_from == n_queries and to - at == n_candidates:
                scores += weighted
            else:
                scores[np.ix_(q_rows[q_from:q_to], rows[at:to])] += weighted
        q_from, at = q_to, to
    return scores if exact else np.clip(scores, _LOW + 1, _HIGH).astype(np.int64)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of rows of whole numbers against rows of whole numbers."""
    return scatter(postings(queries), len(queries), postings(candidates), len(candidates))


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to the smaller id; _NONE marks the query's own row."""
    there = np.flatnonzero(scores != _NONE)
    if len(there) > k:
        bar = np.partition(scores[there], len(there) - k)[len(there) - k]
        there = there[scores[there] >= bar]
    order = np.lexsort((ids[there], ~scores[there]))
    return there[order][:k]


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int, id, score long): the k best candidates of every query row.

    Queries are the rows whose id `every` divides; candidates are all rows but the query's
    own. Rows that repeat an id are rows of their own, as queries and as candidates. Missing
    components of shorter vectors count as 0. Fewer candidates give fewer ranks, an empty
    table none.
    """
    rows = checkpointed(quantised(vectors, scale=scale, id_col=id_col, vector_col=vector_col))
    blocks = checkpointed(_packed(rows, CANDIDATE_BLOCK))
    asked = _packed(rows.filter(F.col("id") % every == 0), QUERY_BLOCK)
    asked = checkpointed(asked)
    n_blocks, n_asked = blocks.count(), asked.count()
    # a cell for each pair of blocks up to MOST_CELLS; the sides as the rows that are copied along them
    cells = max(1, min(MOST_CELLS, n_blocks * n_asked))
    down = min(max(1, n_asked), max(1, round((cells * n_asked * QUERY_BLOCK / max(1, n_blocks * CANDIDATE_BLOCK)) ** 0.5)))
    across = min(max(1, n_blocks), max(1, cells // down))
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("ids", "copies"), F.lit(n)).cast("int")
    keyed = blocks.withColumn("i", part(across)).withColumn("j", side(down))
    spread = asked.withColumn("j", part(down)).withColumn("i", side(across)).select("i", "j", *[F.col(c).alias(f"q_{c}") for c in asked.columns])
    pairs = keyed.join(spread, ["i", "j"]).drop("i", "j")
    out_schema = pa.schema([("query_id", pa.int64()), ("copy", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                copies, q_copies = np.frombuffer(row["copies"], "<i4"), np.frombuffer(row["q_copies"], "<i4")
                held, asked_for = ((np.frombuffer(row[f"{p}ends"], "<i4"), np.frombuffer(row[f"{p}rows"], "<i4"), np.frombuffer(row[f"{p}weights"], "<f8")) for p in ("", "q_"))
                scores = scatter(asked_for, len(q_ids), held, len(ids))
                own = {key: at for at, key in enumerate(zip(ids.tolist(), copies.tolist(), strict=True))}
                best = []
                for n, key in enumerate(zip(q_ids.tolist(), q_copies.tolist(), strict=True)):
                    if key in own:
                        scores[n, own[key]] = _NONE
                    best.append(select_top(scores[n], ids, k))
                sizes = [len(b) for b in best]
                at = np.concatenate(best) if best else np.zeros(0, np.int64)
                rows_of = np.repeat(np.arange(len(q_ids)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows_of]), pa.array(q_copies[rows_of]), pa.array(ids[at]), pa.array(scores[rows_of, at])], schema=out_schema)

    partial = pairs.mapInArrow(run, "query_id long, copy int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
