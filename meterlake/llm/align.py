"""Operator 13: how the tokens of two tokenizers lie over each other in the same texts.

Texts are encoded in Arrow batches by a byte-level model (A, over a space and the text) and a
SentencePiece model (B, which puts the space in front itself). Ids are list arrays: flattened
with the numbers of their parents, ends of tokens as cumulative sums within each document.
Ends that both sides share come from an Acero hash join on (document, end); they cut the
tokens into groups, and every pair of tokens whose bytes overlap is a link.

How many documents hold a pair linked is counted in two steps: `Table.group_by` counts within
a block of some 16 MB of text, and Spark merges those counts. A block keeps a list of its
different pairs, and documents refer to it by number, so totals go back to a block once per
different pair and not once per link: a pair that every document has is one row per block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .byte_bpe import ByteModel, read_vocabulary
from .common import _slices, stored
from .pieces import _MEMO, _SHORT, SPACE, PieceModel

#: Bytes of text that are aligned at a time, and of a block whose pairs are counted together; one text may be longer.
SLICE_BYTES, BLOCK_BYTES = 1_000_000, 16_000_000
#: Pairs of a block in one row.
_PAIRS_ROW = 20_000
_AB = 32
_ONE_THREAD = {"use_threads": False}
_MEASURES = "n_a long, n_b long, n_groups long, n_links long"


def _binary(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary())


class LibraryPieces(PieceModel):
    """The model of operator 9, with the SentencePiece library for segments that aren't remembered."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts without end ids; none for an empty one."""
        cut = [self._cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self._known) > _MEMO:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        fresh, here = [], []
        for part in set().union(*cut).difference(known):
            ids = older.get(part)
            if ids is not None:
                known[part] = ids
            elif part[0] != SPACE or part == SPACE:  # the library puts a space before what it gets, but nothing before nothing
                known[part] = self._encoded(part)
            else:
                fresh.append(part)
            if len(part) > _SHORT:
                here.append(part)
        for part, ids in zip(fresh, self._library.encode([p[1:].replace(SPACE, " ") for p in fresh], num_threads=1), strict=True):
            known[part] = array("I", ids).tobytes()
        get = known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for part in here:
            del known[part]
        return out


class LibraryBytes(ByteModel):
    """The model of operator 11, with the tiktoken library for pieces that aren't remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__(ranks, pattern, _MEMO)
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encoded(self, parts: list[str]) -> list[bytes]:
        encode = self._library.encode_ordinary
        return [array("I", encode(p)).tobytes() for p in parts]


@lru_cache(maxsize=2)
def library_bytes(path: str, pattern: str) -> LibraryBytes:
    """One model per Python worker, path and pattern."""
    return LibraryBytes(read_vocabulary(path), pattern)


@lru_cache(maxsize=2)
def library_pieces(path: str) -> LibraryPieces:
    """One model per Python worker and path."""
    return LibraryPieces(path)


class Aligner:
    """Both models, and the alignment of a batch of texts."""

    def __init__(self, a: ByteModel, b: PieceModel) -> None:
        self.a, self.b = a, b
        self._bytes = _binary(a.tokens), _binary(b.raw)
        self._sizes = tuple(pc.binary_length(x).cast(pa.int64()) for x in self._bytes)
        most = max(len(a.tokens), len(b.raw))
        #: Digits of each id with each of the separators behind them, at 3 * id + 0, 1, 2.
        self._shown = _binary([f"{i}{s}".encode() for i in range(most) for s in ",|;"])

    def _encoded(self, texts: Sequence[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides; none where a text is empty or the tokens of a side don't spell it."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        ids = self.a.encode_all([" " + s if s else "" for s in strings]), self.b.encode_all(strings)
        whole = b"".join([b" " + t for t in texts if t])
        if all(self._spelled(side, k) == whole for k, side in enumerate(ids)):
            return ids
        good = [bool(t) and all(self._spelled([side[n]], k) == b" " + t for k, side in enumerate(ids)) for n, t in enumerate(texts)]
        return tuple([x if g else b"" for x, g in zip(side, good, strict=True)] for side in ids)

    def _spelled(self, ids: list[bytes], k: int) -> bytes:
        taken = self._bytes[k].take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return taken.buffers()[2].to_pybytes() if len(taken) else b""

    @staticmethod
    def _lists(ids: list[bytes]) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    def _ends(self, tokens: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, document, end within all texts, end within its document) of each token."""
        ids, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens).to_numpy()
        ends = pc.cumulative_sum(self._sizes[k].take(ids)).to_numpy()
        starts = tokens.offsets.to_numpy()
        base = np.concatenate(([0], ends))[starts[:-1]]
        return ids.to_numpy(), parent, ends, ends - base[parent]

    def align(self, texts: Sequence[bytes]) -> dict:
        """Per text: n_a, n_b, n_groups, n_links, groups (bytes of the text form); per (text, pair): doc, pair, n links."""
        a_lists, b_lists = map(self._lists, self._encoded(texts))
        (a, a_doc, a_end, a_in), (b, b_doc, b_end, b_in) = self._ends(a_lists, 0), self._ends(b_lists, 1)
        docs = len(texts)
        count = lambda parent: np.bincount(parent, minlength=docs)
        n_a, n_b = count(a_doc), count(b_doc)
        side = lambda name, doc, end: pa.table({"end": doc.astype(np.int64) << 40 | end, name: np.arange(len(doc), dtype=np.int32)})
        shared = side("a", a_doc, a_in).join(side("b", b_doc, b_in), "end", join_type="inner", **_ONE_THREAD)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[shared.column("a").to_numpy()] = b_last[shared.column("b").to_numpy()] = True
        # tokens of a group end at its shared end or before it
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # tokens overlap from the first of B that ends after the start of one of A, to the first that ends with or after it
        first = b_end.searchsorted(np.concatenate(([0], a_end[:-1])) if len(a_end) else a_end, "right")
        links = b_end.searchsorted(a_end, "left") + 1 - first
        of_a = np.repeat(np.arange(len(a)), links)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(links) - links - first, links)
        pair = a[of_a].astype(np.int64) << _AB | b[of_b]
        counted = pa.table({"doc": a_doc[of_a].astype(np.int32), "pair": pair}).group_by(["doc", "pair"], **_ONE_THREAD).aggregate([([], "count_all")])
        return {
            "n_a": n_a, "n_b": n_b, "n_links": np.bincount(a_doc, links, docs).astype(np.int64),
            "n_groups": count(a_doc[a_last]), "groups": self._groups(a, a_group, a_last, b, b_group, b_last, n_a + n_b),
            "counted": (counted.column("doc").to_numpy(), counted.column("pair").to_numpy(), counted.column("count_all").to_numpy().astype(np.int32)),
        }

    def _groups(self, a: np.ndarray, a_group: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_group: np.ndarray, b_last: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2` of each text: the strings of all tokens side by side, cut by document."""
        a_to, b_to = a_last.nonzero()[0] + 1, b_last.nonzero()[0] + 1  # tokens through each group
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.concatenate(([0], b_to))[a_group]] = 3 * a.astype(np.int64) + a_last
        shown[np.arange(len(b)) + a_to[b_group]] = 3 * b.astype(np.int64) + 2 * b_last
        taken = self._shown.take(pa.array(shown))
        if not len(taken):
            return [b""] * len(sizes)
        offsets, data = np.frombuffer(taken.buffers()[1], "<i8"), memoryview(taken.buffers()[2])
        bounds = offsets[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [bytes(data[x : y - 1]) if y > x else b"" for x, y in zip(bounds, bounds[1:])]  # noqa: B905


class _Block:
    """Documents of some slices, until their pairs are numbered together."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes, self.docs = number, 0, 0
        self.ids: list[pa.Array] = []
        self.columns: dict[str, list] = {}
        self.doc: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, ids: pa.Array, columns: dict[str, Sequence], counted: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> None:
        doc, pair, links = counted
        self.ids.append(ids)
        for name, values in columns.items():
            self.columns.setdefault(name, []).append(pa.array(values))
        self.doc.append(doc + np.int32(self.docs))
        self.pair.append(pair)
        self.links.append(links)
        self.docs += len(ids)
        self.bytes += size

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then rows of up to _PAIRS_ROW pairs with the number of documents of this block that hold them."""
        doc, pair, links = np.concatenate(self.doc), pa.array(np.concatenate(self.pair)), np.concatenate(self.links)
        partial = pa.table({"pair": pair}).group_by("pair", **_ONE_THREAD).aggregate([([], "count_all")])
        pairs, held = partial.column("pair").combine_chunks(), partial.column("count_all").combine_chunks()
        order = np.argsort(doc, kind="stable")
        at = pc.index_in(pair, pairs).to_numpy()[order]
        bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.docs)))), pa.int32())
        given = {
            **{k: pa.concat_arrays(v) for k, v in self.columns.items()}, "id__": pa.concat_arrays(self.ids),
            "at": pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), "links": pa.ListArray.from_arrays(bounds, pa.array(links[order], pa.int32())),
        }
        yield self._rows(schema, self.docs, given)
        starts = np.arange(0, len(pairs), _PAIRS_ROW)
        if len(starts):
            bounds = pa.array(np.append(starts, len(pairs)), pa.int32())
            yield self._rows(schema, len(starts), {"first": pa.array(starts), "pairs": pa.ListArray.from_arrays(bounds, pairs), "held": pa.ListArray.from_arrays(bounds, held)})

    def _rows(self, schema: pa.Schema, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        given = given | {"block": pa.array(np.full(n, self.number, np.int64))}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _blocks(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """Rows of documents (block, id__, measures, groups_sha256, at, links) and of pairs (block, first, pairs, held)."""
    source = docs.select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").cast("binary").alias("text__"))
    fields = f"block long, {_MEASURES}, groups_sha256 string{', groups string' * with_groups}, at array<int>, links array<int>, first long, pairs array<long>, held array<long>"
    schema = StructType([*source.select("id__").schema, *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(library_bytes(a_path, pattern), library_pieces(b_path))
        # blocks of a task are numbered within the task, so a repeated task numbers them alike
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for ids, texts in _slices(batch, SLICE_BYTES):
                raw = [t or b"" for t in texts.to_pylist()]
                found = aligner.align(raw)
                columns = {k: found[k] for k in ("n_a", "n_b", "n_groups", "n_links")}
                columns["groups_sha256"] = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]
                if with_groups:
                    columns["groups"] = [g.decode() for g in found["groups"]]
                block.add(ids, columns, found["counted"], sum(map(len, raw)))
                if block.bytes >= BLOCK_BYTES:
                    yield from block.batches(arrow)
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield from block.batches(arrow)

    return source.mapInArrow(run, schema)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, at, pair, held): pairs of each block, by number."""
    listed = blocks.filter(F.col("pairs").isNotNull()).select("block", "first", F.posexplode(F.arrays_zip("pairs", "held")).alias("k", "x"))
    return listed.select("block", (F.col("first") + F.col("k")).cast("int").alias("at"), F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))


def _totals(pairs: DataFrame) -> DataFrame:
    """(pair, docs, best): documents of each pair, and whether no pair of the same A id has more.

    An A id meets at most as many B ids as B has, so its window is bounded by the vocabulary.
    """
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", _AB)))
    return counts.withColumn("best", F.col("docs") == most)


def pair_counts(docs: DataFrame, a_path: str, pattern: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a int, b int, docs long, best boolean): how many rows hold each pair of ids linked, and whether it is the A id's most frequent, ties included."""
    totals = _totals(_block_pairs(_blocks(docs, a_path, pattern, b_path, id_col, text_col, False)))
    return totals.select(F.shiftright("pair", _AB).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << _AB) - 1).cast("int").alias("b"), "docs", "best")


def align_tokenizers(docs: DataFrame, a_path: str, pattern: str, b_path: str, *, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256), and `groups` as text on request, of every row.

    a_path: byte-level BPE as tokenizer JSON or ranks, cut by `pattern`; b_path: SentencePiece
    BPE model. n_best: links whose pair the most documents hold among pairs of the same A id,
    ties included; count_sum: documents of the pair, summed over links. Null and empty texts,
    and texts that the tokens of a side don't spell, have no tokens: zeros and ''. Repeated
    rows and null ids count as documents of their own and come out once each; only the two
    named columns are read, so others may have any name; an empty table gives no rows.
    """
    blocks = stored(_blocks(docs, a_path, pattern, b_path, id_col, text_col, with_groups), "aligned")
    pairs = _block_pairs(blocks)
    told = pairs.join(_totals(pairs), "pair").select(F.col("block").alias("of_block"), F.col("at").alias("number"), "docs", "best")
    kept = ["id__", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups]
    rows = blocks.filter(F.col("pairs").isNull()).select("block", *kept, "at", "links")
    schema = StructType([*rows.select(*kept).schema, *StructType.fromDDL("n_best long, count_sum long")])
    arrow = to_arrow_schema(schema)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of a block with the totals of its pairs."""
        docs_of = np.zeros(len(right), np.int64)
        best_of = np.zeros(len(right), bool)
        at = right.column("number").to_numpy()
        docs_of[at], best_of[at] = right.column("docs").to_numpy(), right.column("best").to_numpy()
        lists, links = left.column("at").combine_chunks(), pc.list_flatten(left.column("links")).to_numpy()
        parent, at = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
        ends = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=len(left)))))
        total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[ends])
        out = left.select(kept).append_column("n_best", pa.array(total(links * best_of[at]))).append_column("count_sum", pa.array(total(links * docs_of[at])))
        return out.cast(arrow)

    found = rows.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(summed, schema)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return found.select(F.col("id__").alias(id_col), *order)
