"""Operator 9: SentencePiece (BPE model with byte fallback), encoded by backtracking.

BPE merges are never replayed on whole texts. A sequence of pieces is the model's encoding
exactly when every adjacent pair is *compatible*: merging the characters of the two pieces
alone gives those two pieces again. Prefix encodings are unique, so a left-to-right search
over the longest matches (found by one Aho-Corasick pass), which falls back to shorter ones
and marks positions from which no completion exists, ends at the one valid sequence.

Words repeat: no piece has a space mark after another character (checked when the model is
read), so a text is cut before each run of space marks and around line feeds, and the ids of
short segments are remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
#: Ids above this stand for characters without a piece; they become byte pieces.
_CHAR = 1 << 24
#: Remembered segments of a generation, their longest length, and remembered pairs of a generation, per Python worker.
_MEMO, _SHORT, _PAIRS = 200_000, 48, 400_000


class PieceModel:
    """Vocabulary of a model file, with exact encode and decode."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.pieces: list[str] = []
        self.raw: list[bytes] = []
        self.sizes: list[int] = []
        self.bytes_: dict[int, int] = {}
        self.matcher = ahocorasick.Automaton()
        for i in range(size):
            piece = model.id_to_piece(i)
            self.pieces.append(piece)
            self.sizes.append(len(piece))
            if model.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if len(self.bytes_) != 256 or any(inner.search(p) or ("\n" in p and len(p) > 1) or any(c not in self.ids for c in p) for p in self.ids):
            raise ValueError(f"{path}: not a BPE model with byte fallback whose pieces keep spaces in front")
        self._cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        # two generations each: what is still in use moves from the older one to the younger one
        self._pairs: dict[int, bool] = {}
        self._older_pairs: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives the two pieces again."""
        if left >= _CHAR or right >= _CHAR:
            return True
        key = left << 24 | right
        known = self._pairs.get(key)
        if known is None:
            known = self._older_pairs.get(key)
            if known is None:
                a, b = self.pieces[left], self.pieces[right]
                known = self._merge(a + b) == [a, b]
            self._pairs[key] = known
            if len(self._pairs) > _PAIRS:
                self._older_pairs, self._pairs = self._pairs, {}
        return known

    def _alone(self, piece: int) -> bool:
        """Whether a piece is its own encoding."""
        if piece >= _CHAR:
            return True
        key = 1 << 60 | piece
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._merge(self.pieces[piece]) == [self.pieces[piece]]
        return known

    def segment(self, text: str) -> list[int]:
        """Pieces of a text in which spaces are already marks; ids above 2^24 are single unknown characters."""
        n = len(text)
        found: list[list[int]] = [[] for _ in range(n)]
        for end, (i, size) in self.matcher.iter(text):
            found[end + 1 - size].append(i)  # ends rise, so the longest comes last
        for k, options in enumerate(found):
            if not options:  # a known character is a piece itself
                options.append(_CHAR + ord(text[k]))
        # most texts need no step back: the longest compatible match, again and again
        out: list[int] = []
        known, sizes, at, last = self._pairs, self.sizes, 0, -1
        while at < n:
            for i in reversed(found[at]):
                if last < 0:
                    good = self._alone(i)
                else:
                    good = known.get(last << 24 | i)
                    if good is None:
                        good = self._compatible(last, i)
                        known = self._pairs
                if good:
                    break
            else:
                return self._search(text, found)
            out.append(i)
            at += sizes[i] if i < _CHAR else 1
            last = i
        return out

    def _search(self, text: str, found: list[list[int]]) -> list[int]:
        """Backtracking over the matches from each start; positions without a completion are marked."""
        n = len(text)
        pieces = self.pieces
        failed = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, rank = 0, len(found[0]) - 1
        while at < n:
            options, hit = found[at], -1
            while rank >= 0:
                i = options[rank]
                end = at + (len(pieces[i]) if i < _CHAR else 1)
                if not failed[end] and (self._compatible(out[-1], i) if out else self._alone(i)):
                    hit = i
                    break
                rank -= 1
            if hit >= 0:
                out.append(hit)
                tried.append(rank)
                at = end
                rank = len(found[at]) - 1 if at < n else 0
            else:
                failed[at] = 1
                if not out:
                    raise AssertionError("no segmentation: every text has one")
                i = out.pop()
                at -= len(pieces[i]) if i < _CHAR else 1
                rank = tried.pop() - 1
        return out

    def _encoded(self, part: str) -> bytes:
        ids: list[int] = []
        for i in self.segment(part):
            if i < _CHAR:
                ids.append(i)
            else:
                ids.extend(self.bytes_[b] for b in chr(i - _CHAR).encode("utf-8", "surrogatepass"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, begin and end ids included."""
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        if not text:
            return ends
        parts = self._cut.findall(SPACE + text.replace(" ", SPACE))
        if len(self._known) > _MEMO:
            self._older, self._known = self._known, {}
        known = self._known
        long: dict[str, bytes] = {}
        for part in set(parts).difference(known):
            ids = self._older.get(part) or self._encoded(part)
            (known if len(part) <= _SHORT else long)[part] = ids
        body = b"".join([known[p] for p in parts] if not long else [known[p] if p in known else long[p] for p in parts])
        return ends[:4] + body + ends[4:]

    def decode(self, ids: bytes) -> str:
        """Text of ids as `encode` returns them; the space put in front by the model goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        text = b"".join(map(self.raw.__getitem__, numbers))
        first = next((i for i in numbers if self.raw[i]), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker and path."""
    return PieceModel(path)


def encode_texts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string): whole texts encoded with begin and end ids, and decoded again.

    `ids` are little-endian unsigned 32-bit integers. Null and empty texts give the two end
    ids and an empty text. One row per input row; empty input gives none.
    """

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        model = piece_model(model_path)
        ids = [model.encode(t.decode("utf-8", "replace")) for t in texts]
        return {"ids": ids, "decoded": [model.decode(x) for x in ids]}

    return map_texts(docs, work, "ids binary, decoded string", id_col=id_col, text_col=text_col)


def encode_digests(docs: DataFrame, model_path: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as `encode_texts`, with digests in place of the content.

    with_ids adds the ids themselves as binary.
    """

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        model = piece_model(model_path)
        ids = [model.encode(t.decode("utf-8", "replace")) for t in texts]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(model.decode(x).encode()) for x in ids], "ids": ids}

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_texts(docs, work, fields, id_col=id_col, text_col=text_col)
