"""Operator 8: language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features (hashed), transitions between the
labels of neighbouring words are learned, and forward-backward gives every word's label
probabilities, so a code-switched text is labelled word by word. A document's prediction is
the label with the most probability over its words, each weighted by its letters.

The model is fitted on the driver from a bounded sample of labelled rows: `sample_rows` in all,
shared evenly by the labels (one of each label at least), by smallest hash; of a text longer
than `sample_chars` characters a piece of that length from a random place is learned. Spans of
different documents are strung together so that changes of language occur in training. The
gradient is that of the log likelihood: word marginals for the features, pair marginals of
forward-backward for the transitions. Prediction reads every whole text. Forward-backward runs over blocks of words of many texts at once: block products
first, then messages between the blocks of a text, then within blocks, which is exact for
texts of any length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_texts

BITS = 16
BLOCK = 128
_MEMO = 200_000
#: Words whose features are made at once.
_WORDS = 50_000
_CHUNK = 1 << 17
UNKNOWN = "und"


def letters_of(token: str) -> str:
    """The characters of Unicode category L."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def features(letters: Sequence[str], lexicon: dict[str, str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of the letters of lower-cased words, by family: (word number, feature), in order of words.

    Families: n-grams of 2 and 3 bytes of the word with marked ends, prefixes and suffixes of 1
    to 4 bytes, the lexicon entry. Words without letters have none.
    """
    marked = [f"^{x}$".encode() if x else b"" for x in letters]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    windows, out = [data], []
    for n in range(1, 4):
        windows.append((windows[-1][:-1] << np.uint32(8)) | data[n:])

    def hashed(n: int, at: np.ndarray, tag: int) -> np.ndarray:
        code = windows[n - 1][at] + np.uint32(tag * 0x85EBCA6B & 0xFFFFFFFF)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
        return ((code ^ (code >> np.uint32(13))) >> np.uint32(32 - BITS)).astype(np.int64)

    owner, place = np.repeat(np.arange(len(marked)), sizes), np.arange(int(sizes.sum()))
    for n in (2, 3):
        inside = place + n <= ends[owner]
        out.append((owner[inside], hashed(n, place[inside], n)))
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(sizes >= n + 2)
        out += [(long, hashed(n, starts[long] + 1, 10 + n)), (long, hashed(n, ends[long] - 1 - n, 20 + n))]
    entries = {label: zlib.crc32(b"lex=" + label.encode()) & ((1 << BITS) - 1) for label in set(lexicon.values())}
    known = [(i, entries[label]) for i, x in enumerate(letters) if (label := lexicon.get(x)) is not None]
    out.append((np.array([i for i, _ in known], np.int64), np.array([f for _, f in known], np.int64)))
    return out


@dataclass
class Model:
    """Labels, feature weights (2^BITS x labels), transition scores (labels x labels), lexicon."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, str]
    rows_: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("labels", "weights", "transitions", "lexicon")} | {"rows_": {}}

    def emissions(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each token in a table of emission scores; the table; letters per table row."""
        if not self.rows_ or len(self.rows_) > _MEMO:
            self.rows_ = {"": 0}
            self._table, self._letters = np.zeros((1, len(self.labels)), np.float32), np.zeros(1, np.int64)
        new = list(set(tokens).difference(self.rows_))
        if new:
            letters = [letters_of(t) for t in new]
            table = np.zeros((len(new), len(self.labels)), np.float32)
            for c in range(0, len(new), _WORDS):
                for owner, flat in features(letters[c : c + _WORDS], self.lexicon):
                    if len(owner):
                        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                        table[c + owner[starts]] += np.add.reduceat(self.weights[flat], starts, axis=0)
            at = len(self.rows_)
            self.rows_.update(zip(new, range(at, at + len(new)), strict=True))
            self._table = np.concatenate([self._table, table])
            self._letters = np.concatenate([self._letters, np.fromiter(map(len, letters), np.int64, len(letters))])
        return np.fromiter(map(self.rows_.__getitem__, tokens), np.int64, len(tokens)), self._table, self._letters


def _normal(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-30)


def posteriors(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; scores: words of texts one after another, sizes: words of each text."""
    return marginals(scores, sizes, transitions)[0]


def marginals(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, *, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of every word, and the expected number of each pair of neighbouring labels if asked for."""
    k = scores.shape[1]
    sizes = sizes[sizes > 0]
    if not len(scores):
        return np.zeros((0, k), np.float32), np.zeros((k, k))
    blocks = -(-sizes // BLOCK)
    firsts = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(len(scores)) - np.repeat(starts, sizes)
    where = (np.repeat(firsts, sizes) + at // BLOCK) * BLOCK + at % BLOCK
    count = int(blocks.sum())
    e = np.ones((count * BLOCK, k), np.float32)
    e[where] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-9
    there = np.zeros(count * BLOCK, bool)
    there[where] = True
    e, there = e.reshape(count, BLOCK, k), there.reshape(count, BLOCK)
    t = np.exp(transitions - transitions.max()).astype(np.float32)
    opening = np.zeros(count, bool)
    opening[firsts] = True
    eye = np.eye(k, dtype=np.float32)
    # product of each block's matrices; the first word of a text has no transition
    product = np.where(opening[:, None, None], eye, t)[:, :, :] * e[:, None, 0, :]
    for s in range(1, BLOCK):
        step = _normal((product.reshape(-1, k) @ t).reshape(count, k, k) * e[:, None, s, :], (1, 2))
        product = np.where(there[:, s, None, None], step, product)
    into, out = np.full((count, k), 1 / k, np.float32), np.full((count, k), 1 / k, np.float32)
    for j in range(1, int(blocks.max())):
        c = firsts[blocks > j] + j
        into[c] = _normal(np.einsum("ci,cij->cj", into[c - 1], product[c - 1]))
        c = firsts[blocks > j] + blocks[blocks > j] - 1 - j
        out[c] = _normal(np.einsum("cij,cj->ci", product[c + 1], out[c + 1]))
    alpha = np.empty_like(e)
    now = into
    for s in range(BLOCK):
        moved = now @ t
        if s == 0:
            moved = np.where(opening[:, None], now, moved)
        now = np.where(there[:, s, None], _normal(moved * e[:, s]), now)
        alpha[:, s] = now
    forward = alpha.copy() if with_pairs else None
    ahead = np.empty_like(e) if with_pairs else None
    beta = out
    for s in range(BLOCK - 1, -1, -1):
        after = beta
        alpha[:, s] *= after
        if ahead is not None:
            ahead[:, s] = after * e[:, s]
        moved = _normal((after * e[:, s]) @ t.T)
        beta = np.where(there[:, s, None], moved, beta)
    found = _normal(alpha.reshape(-1, k)[where])
    if forward is None:
        return found, None
    # a pair's probability: what leads to the first word, the transition, and what the second word and all after it say
    pairs, left, right = np.zeros((k, k)), forward.reshape(-1, k)[where], ahead.reshape(-1, k)[where]
    inner = np.flatnonzero(at[1:])
    for c in range(0, len(inner), _CHUNK):
        i = inner[c : c + _CHUNK]
        pairs += _normal((left[i][:, :, None] * t * right[i + 1][:, None, :]).astype(np.float64), (1, 2)).sum(axis=0)
    return found, pairs


def fit(rows: Sequence[tuple[str, str]], *, rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, lexicon_size: int = 400, seed: int = 7) -> Model:
    """CRF of (text, label) rows by Adam on the conditional likelihood of strung-together spans."""
    labels = sorted({label for _, label in rows}) or [UNKNOWN]
    k, rng = len(labels), np.random.default_rng(seed)
    counts: dict[str, Counter] = {label: Counter() for label in labels}
    spans: list[tuple[int, list[str]]] = []
    for text, label in rows:
        words = text.lower().split()
        counts[label].update(x for w in words if (x := letters_of(w)))
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 60))
            spans.append((labels.index(label), words[at : at + n]))
            at += n
    best: dict[str, tuple[float, str]] = {}
    for label in labels:
        total = sum(counts[label].values()) or 1
        for w, n in sorted(counts[label].items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            best[w] = max(best.get(w, (0.0, "")), (n / total, label))
    model = Model(labels, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32), {w: label for w, (_, label) in best.items()})
    words, gold = [], []
    for s in rng.permutation(len(spans)):
        label, span = spans[s]
        words += span
        gold += [label] * len(span)
    words, gold = words[: len(words) // BLOCK * BLOCK or None], np.array(gold[: len(gold) // BLOCK * BLOCK or None], np.int64)
    if not words or k == 1:
        return model
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = features([letters_of(w) for w in distinct], model.lexicon)
    owner, flat = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.fromiter((distinct[w] for w in words), np.int64, len(words))
    sizes = np.full(max(1, len(words) // BLOCK), min(BLOCK, len(words)), np.int64)
    onehot = np.eye(k, dtype=np.float32)[gold]
    inner = np.flatnonzero(np.arange(1, len(words)) % BLOCK)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[inner], gold[inner + 1]), 1)
    parameters = [model.weights, model.transitions]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for r in range(1, rounds + 1):
        table = np.stack([np.bincount(owner, model.weights[flat, c], len(distinct)) for c in range(k)], axis=1).astype(np.float32)
        scores = table[at]
        p, expected = marginals(scores, sizes, model.transitions, with_pairs=True)
        wrong = (p - onehot) / len(words)
        by_word = np.stack([np.bincount(at, wrong[:, c], len(distinct)) for c in range(k)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, c], 1 << BITS) for c in range(k)], axis=1) + decay * model.weights / len(words) ** 0.5
        gt = (expected - pairs) / len(inner) + decay * model.transitions
        for value, grad, (m, v) in zip(parameters, (g, gt), moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value -= (rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)).astype(np.float32)
    return model


def training_rows(docs: DataFrame, *, sample_rows: int = 500, sample_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """Labelled rows (text, label) with a letter, by label then hash of id and text: sample_rows in all, shared evenly by the labels.

    A label gets one row at least, so there are at most max(sample_rows, number of labels) of
    up to `sample_chars` characters; a longer text gives a piece from a place that its hash
    names. Rows that are alike in id, text and label count once.
    """
    text, label = F.col(text_col).cast("string"), F.col(label_col).cast("string")
    rows = docs.select(text.alias("t"), label.alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text).alias("h2")).filter(F.col("t").rlike("\\p{L}") & F.col("y").isNotNull())
    labels = rows.select("y").distinct().count()
    if not labels:
        return []
    # hashes first: a task sends its best few of each label, not as many texts
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "h2"))
    keys = rows.select("y", "h", "h2").withColumn("n", rank).filter(F.col("n") <= max(1, sample_rows // labels)).select("y", "h", "h2").distinct()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(keys.collect(), keys.schema))
    start = F.pmod("h2", F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1) + 1
    piece = F.substring("t", start.cast("int"), F.lit(sample_chars))
    few = rows.join(chosen, ["y", "h", "h2"]).groupBy("y", "h", "h2").agg(F.min(piece).alias("t")).collect()
    return [(r["t"], r["y"]) for r in sorted(few, key=lambda r: (r["h"], r["h2"], r["y"]))]


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_switches): label of every whole text.

    A text that is null, empty or without letters (Unicode category L) is `und` with score 0. n_switches counts
    changes of the likeliest label between neighbouring words. One row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        m = shared.value
        tokens, sizes = [], np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts):
            words = raw.decode("utf-8", "replace").lower().split()
            sizes[i] = len(words)
            tokens += words
        at, table, letters = m.emissions(tokens)
        p = posteriors(table[at], sizes, m.transitions)
        weight = letters[at].astype(np.float64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        mass = np.stack([np.bincount(owner, p[:, c] * weight, len(texts)) for c in range(len(m.labels))], axis=1)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        top = p.argmax(axis=1)
        change = (top[1:] != top[:-1]) & (owner[1:] == owner[:-1])
        switches = np.bincount(owner[1:], change, len(texts)).astype(np.int64) if len(top) else np.zeros(len(texts), np.int64)
        return {
            "lang_pred": [m.labels[b] if n > 0 else UNKNOWN for b, n in zip(best.tolist(), total.tolist(), strict=True)],
            "score": [float(mass[i, b] / n) if n > 0 else 0.0 for i, (b, n) in enumerate(zip(best.tolist(), total.tolist(), strict=True))],
            "n_switches": switches,
        }

    return map_texts(docs, work, "lang_pred string, score double, n_switches long", id_col=id_col, text_col=text_col)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **sample) -> DataFrame:
    """(id, held_out, lang_pred, score, n_switches): fitted on rows whose crc32(id) mod 5 is not 0, applied to all."""
    out = held_out(id_col)
    model = fit(training_rows(docs.filter(~out), id_col=id_col, text_col=text_col, label_col=label_col, **sample))
    return predict(docs, model, id_col=id_col, text_col=text_col).select(id_col, out.alias("held_out"), "lang_pred", "score", "n_switches")
