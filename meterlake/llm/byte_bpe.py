"""Operator 11: byte-level BPE, encoded by a two-tier look-up.

Each match of the pre-token pattern is encoded by itself. Tier one is a minimal perfect hash
over the vocabulary: as many slots as tokens, a displacement per small bucket chosen so that
no two tokens share a slot, and the token in the slot compared with the pre-token. Many
pre-tokens are looked up at once, and most text ends here. Tier two takes what is not one
token: its bytes are a doubly linked list, and a heap gives the pair of lowest rank to merge,
the leftmost of equals, so a pre-token of n bytes takes n log n steps. Short ones share one
heap of ranks, each with the places that wait for it: pre-tokens don't touch each other, so
one step merges the pairs of a rank in many of them at once. A long one has a heap of its own.

Pre-tokens never reach over a space that stands between other characters, so texts are first
cut there, and the ids of short pieces are remembered in a bounded table per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts

#: Characters with the property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
#: A run of other characters with a space before it, or white space as the pre-token pattern cuts it.
_CUT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
#: Remembered pieces of a generation and their longest length.
_MEMO, _SHORT = 400_000, 48
#: Pre-tokens of up to so many bytes share a heap; a longer one has its own.
_SHARED = 64
#: Stands for no token in pairs.
_NONE = (1 << 20) - 1
#: Tokens of a bucket of the perfect hash, on average.
_BUCKET = 3
_M64 = (1 << 64) - 1
#: Marks the displacement of a bucket of one key: the rest is its slot.
_DIRECT = np.uint64(1 << 63)


class PerfectHash:
    """Minimal perfect hash of different byte strings: n keys in n slots (hash and displace)."""

    def __init__(self, keys: Sequence[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, self.size // _BUCKET)
        self.moves = np.zeros(self.buckets, np.uint64)
        slots = np.full(self.size, -1, np.int64)
        self._slots = slots
        if self.size:
            self._build(keys, slots)

    @staticmethod
    def _hashes(keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = [xxhash.xxh3_128_intdigest(k) for k in keys]
        return np.array([x >> 64 for x in both], np.uint64), np.array([x & _M64 for x in both], np.uint64)

    @staticmethod
    def _slot(low: np.ndarray, move: np.ndarray, size: int) -> np.ndarray:
        """Slot of the second hash under a displacement: mixed, so that each displacement deals the keys anew."""
        x = low ^ (move * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        dealt = (x ^ (x >> np.uint64(32))) % np.uint64(size)
        return np.where(move >= _DIRECT, move & ~_DIRECT, dealt).astype(np.int64)

    def _build(self, keys: Sequence[bytes], slots: np.ndarray) -> None:
        high, low = self._hashes(keys)
        bucket = (high % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        tries = np.arange(32, dtype=np.uint64)
        order = np.argsort(-sizes, kind="stable")
        for b in order[sizes[order] > 1].tolist():
            mine = by_bucket[starts[b] : starts[b + 1]]
            first = 0
            while True:
                moves = tries + np.uint64(first)
                places = self._slot(low[mine][:, None], moves[None, :], self.size)
                fits = (slots[places] < 0).all(axis=0)
                ordered = np.sort(places, axis=0)
                fits &= (ordered[1:] != ordered[:-1]).all(axis=0)
                hit = int(fits.argmax())
                if fits[hit]:
                    slots[places[:, hit]] = mine
                    self.moves[b] = moves[hit]
                    break
                first += len(tries)
                if first > 1 << 24:
                    raise ValueError("keys of the perfect hash must differ")
        single = order[sizes[order] == 1]
        free = (slots < 0).nonzero()[0][: len(single)]
        slots[free] = by_bucket[starts[single]]
        self.moves[single] = free.astype(np.uint64) | _DIRECT

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """Number of the only key that each of `keys` can be; the caller compares."""
        high, low = self._hashes(keys)
        move = self.moves[(high % np.uint64(self.buckets)).astype(np.int64)]
        return self._slots[self._slot(low, move, self.size)]


class ByteModel:
    """Tokens and ranks of a byte-level vocabulary, with exact encode and decode. ranks: token -> rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = _MEMO) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks, self._memo = ranks, memo
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self._pattern = regex.compile(pattern)
        # two generations: what is still in use moves from the older one to the younger one
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @cached_property
    def _tier_one(self) -> tuple[PerfectHash, pa.Array, np.ndarray]:
        """The perfect hash, its tokens, and their ids."""
        listed = list(self.ranks)
        return PerfectHash(listed), pa.array(listed, pa.binary()), np.array([self.ranks[t] for t in listed], np.int64)

    @cached_property
    def _tier_two(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the bytes; pairs of ids that join to a token, sorted, and its rank."""
        ranks = self.ranks
        pairs = sorted((ranks[t[:k]] << 20 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        found = np.array(pairs or [(-1, -1)], np.int64)
        return np.array([ranks[bytes([b])] for b in range(256)], np.int64), found[:, 0].copy(), found[:, 1].copy()

    def whole(self, pre_tokens: Sequence[bytes]) -> np.ndarray:
        """Id of each pre-token that is a token itself, else -1 (tier one)."""
        if not len(pre_tokens):
            return np.empty(0, np.int64)
        table, listed, ids = self._tier_one
        at = table.find(pre_tokens)
        same = pc.equal(listed.take(pa.array(at)), pa.array(pre_tokens, pa.binary()))
        return np.where(same.to_numpy(zero_copy_only=False), ids[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging the adjacent pair of lowest rank, again and again (tier two)."""
        n, get = len(piece), self.ranks.get
        ends = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n))  # start of the part that ends here
        pair = [-1] * n  # rank of this part joined with the next
        heap = []
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                heap.append(rank << 32 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue  # a part of it has been merged since
            middle = ends[i]
            end = ends[i] = ends[middle]
            pair[middle] = pair[i] = -1
            if end < n:
                before[end] = i
                rank = get(piece[i : ends[end]])
                if rank is not None:
                    pair[i] = rank
                    heappush(heap, rank << 32 | i)
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end])
                pair[left] = -1 if rank is None else rank
                if rank is not None:
                    heappush(heap, rank << 32 | left)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : ends[i]]))
            i = ends[i]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 if it is no token."""
        _, pairs, joined = self._tier_two
        key = left << 20 | right
        at = np.minimum(pairs.searchsorted(key), len(pairs) - 1)
        return np.where(pairs[at] == key, joined[at], -1)

    def merge_many(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids, as bytes, of each of many short pre-tokens: as `merge`, with one heap for all."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.repeat(np.arange(len(pieces)), sizes)
        n = len(word)
        ends = np.cumsum(sizes)
        # place n stands for "none" before and after each pre-token
        ids = np.append(self._tier_two[0][np.frombuffer(b"".join(pieces), np.uint8)], _NONE)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        after[ends - 1] = after[n] = before[(ends - sizes)[sizes > 0]] = n
        pair = self._rank(ids, ids[after])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(ranks: np.ndarray, places: np.ndarray) -> None:
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):  # noqa: B905
                have = waiting.get(rank)
                if have is None:
                    waiting[rank] = [places[a:b]]
                    heappush(heap, rank)
                else:
                    have.append(places[a:b])

        there = (pair >= 0).nonzero()[0]
        if len(there):
            wait(pair[there], there)
        while heap:
            rank = heappop(heap)
            found = waiting.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[pair[at] == rank]  # others have been merged since
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                here = word[at]
                first = np.append(True, here[1:] != here[:-1])
                if not first.all():  # only the leftmost of a pre-token: a merge may bring a lower rank
                    waiting[rank] = [at[~first]]
                    heappush(heap, rank)
                    at = at[first]
            middle = after[at]
            end = after[middle]
            ids[at], after[at], before[end] = rank, end, at
            pair[middle], alive[middle] = -1, False
            changed = np.concatenate((at, before[at]))
            new = self._rank(ids[changed], ids[after[changed]])
            pair[changed] = new
            there = (new >= 0).nonzero()[0]
            if len(there):
                wait(new[there], changed[there])
        out = ids[:n][alive[:n]].astype("<u4").tobytes()
        parts = np.concatenate(([0], np.cumsum(alive[:n])))[np.concatenate(([0], ends))] * 4
        bounds = parts.tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of different pieces of texts."""
        cut = [self._pattern.findall(p) for p in parts]
        listed = list({x for c in cut for x in c})
        raw = [x.encode("utf-8", "surrogatepass") for x in listed]
        hit = self.whole(raw).tolist()
        ids = {x: i.to_bytes(4, "little") for x, i in zip(listed, hit, strict=True) if i >= 0}
        missed = [(x, r) for x, r, i in zip(listed, raw, hit, strict=True) if i < 0]
        short = [(x, r) for x, r in missed if len(r) <= _SHARED]
        ids.update(zip([x for x, _ in short], self.merge_many([r for _, r in short]), strict=True))
        ids.update((x, np.array(self.merge(r), "<u4").tobytes()) for x, r in missed if len(r) > _SHARED)
        return [b"".join([ids[x] for x in c]) for c in cut]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cut = [_CUT.findall(t) for t in texts]
        if len(self._known) > self._memo:
            self._older, self._known = self._known, {}
        known = self._known
        new = set().union(*cut).difference(known)
        here: dict[str, bytes] = {}
        if new:
            older = self._older
            for p in new:
                ids = older.get(p)
                if ids is not None:
                    known[p] = ids
            fresh = [p for p in new if p not in known]
            for p, ids in zip(fresh, self._encoded(fresh), strict=True):
                (known if len(p) <= _SHORT else here)[p] = ids
        known.update(here)
        get = known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for p in here:
            del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids as `encode_all` returns them."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines: base64 of the token, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_json(path: str) -> dict[bytes, int]:
    """Ranks of a tokenizer file with byte-level BPE without special tokens; its ids must follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special, letters = {t["content"] for t in model["added_tokens"]}, _byte_letters()
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
    merged = [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if model["model"]["type"] != "BPE" or merged != sorted(merged) or len(merged) + 256 != len(ranks):
        raise ValueError(f"{path}: not a byte-level BPE whose ids are the ranks of its merges")
    return ranks


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a tokenizer file (.json) or of a file of ranks."""
    return read_json(path) if path.endswith(".json") else read_ranks(path)


@lru_cache(maxsize=2)
def byte_model(path: str, pattern: str) -> ByteModel:
    """One model per Python worker, path and pattern."""
    return ByteModel(read_vocabulary(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary): whole texts encoded by the ranks in a file, and decoded again.

    `ids` are little-endian unsigned 32-bit integers. Null and empty texts give no ids. One row
    per input row, repeated rows and null ids too; only the two named columns are read, so
    others may have any name; an empty table gives no rows.
    """

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        model = byte_model(path, pattern)
        ids = model.encode_all([t.decode("utf-8", "replace") for t in texts])
        return {"ids": ids, "decoded": [model.decode(x) for x in ids]}

    return map_texts(docs, work, "ids binary, decoded binary", id_col=id_col, text_col=text_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as `encode_texts`, with digests in place of the content."""

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        model = byte_model(path, pattern)
        ids = model.encode_all([t.decode("utf-8", "replace") for t in texts])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(model.decode(x)) for x in ids]}

    return map_texts(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col=id_col, text_col=text_col)
