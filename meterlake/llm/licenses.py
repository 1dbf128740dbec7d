"""Operator 1: licence scan with a positional index of rare licence words.

Templates are short licence notices. The document frequency of every template word is
counted over the whole corpus, and each template is posted under the rarest (highest-IDF) word
of its mandatory phrases. A file looks up only those words: a template whose rarest word isn't
there is never touched. The places of that word give start positions (place in the file minus
offset in the template), which are intersected with those of the template's next rarer words,
within a slack for notices that are reworded, until none is left. What survives is
verified: mandatory key phrases must stand, word after word, inside the aligned window, and
enough of the template's words must be there.

Base phrases are templates with no slack whose rare words are all their words, so the index
finds every place of theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """A licence notice: label, text, and phrases that must all be there. slack: words of drift allowed."""

    label: str
    text: str
    phrases: tuple[str, ...]
    slack: int = 3
    base: bool = False


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), 0, True)


# Phrases and labels of the contract.
BASE = (_base("cc-by", "cc by"), _base("gpl", "general public license"), _base("reserved", "all rights reserved"))

# Wording of public licence notices.
NOTICES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "apache license 2 0", ("apache license 2 0",)),
    Template("apache-2.0", "apache 2 0 license", ("apache 2 0 license",)),
    Template("bsd", "bsd 2 clause license", ("bsd 2 clause",)),
    Template("bsd", "bsd 3 clause license", ("bsd 3 clause",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2.0", "gnu general public license as published by the free software foundation either version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license as published by the free software foundation either version 3", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "mit license", ("mit license",), 0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; every byte of a non-ASCII character belongs to a word."""
    return WORD.findall(text.lower())


class RareWordIndex:
    """Templates by the rarest word of each, and the offsets of its further rare words, rarest first."""

    def __init__(self, templates: Sequence[Template], document_frequency: dict[bytes, int], n_documents: int, rare_words: int = 3) -> None:
        self.templates = list(templates)
        self.words = [words_of(t.text.encode()) for t in self.templates]
        self.phrases = [[words_of(p.encode()) for p in t.phrases] for t in self.templates]
        self.idf = {w: math.log((n_documents + 1) / (document_frequency.get(w, 0) + 1)) for ws in self.words for w in ws}
        by_rarity = lambda w: (-self.idf[w], w)
        self.rare: list[list[tuple[bytes, int]]] = []  # of each template, rarest first, with the offset
        for t, ws in zip(self.templates, self.words, strict=True):
            # only words of the mandatory phrases: a reworded notice still has those
            must = {w for p in t.phrases for w in words_of(p.encode())}
            chosen = sorted(must, key=by_rarity)
            chosen = chosen if t.base else chosen[:rare_words]
            self.rare.append([(w, ws.index(w)) for w in chosen])
        self.by_rarest: dict[bytes, list[int]] = defaultdict(list)
        for k, rare in enumerate(self.rare):
            self.by_rarest[rare[0][0]].append(k)
        self.rarest = frozenset(self.by_rarest)
        self.vocabulary = frozenset(w for rare in self.rare for w, _ in rare)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of the template's words found) of every verified place."""
        present = self.rarest.intersection(words)
        if not present:
            return []
        there = self.vocabulary.intersection(words)
        live = [k for w in present for k in self.by_rarest[w] if all(x in there for x, _ in self.rare[k])]
        if not live:
            return []
        wanted = {w for k in live for w, _ in self.rare[k]}
        places: dict[bytes, list[int]] = {w: [] for w in wanted}
        for at, w in enumerate(words):
            if w in wanted:
                places[w].append(at)
        found = []
        for k in live:
            slack = self.templates[k].slack
            (first, offset), *others = self.rare[k]
            starts = [at - offset for at in places[first]]
            for w, offset in others:
                if not starts:
                    break
                near = {at - offset + d for at in places[w] for d in range(-slack, slack + 1)}
                starts = [s for s in starts if s in near]
            for s in starts:
                if (share := self._verified(k, words, s)) is not None:
                    found.append((k, s, share))
        return found

    def _verified(self, k: int, words: list[bytes], start: int) -> float | None:
        t, size = self.templates[k], len(self.words[k])
        if t.slack == 0:
            return 1.0 if start >= 0 and words[start : start + size] == self.words[k] else None
        window = words[max(0, start - t.slack) : max(0, start + size + t.slack)]
        for phrase in self.phrases[k]:
            n = len(phrase)
            if not any(window[i : i + n] == phrase for i in range(len(window) - n + 1)):
                return None
        here = Counter(window)
        return sum(min(n, here[w]) for w, n in Counter(self.words[k]).items()) / size


def licence_word_counts(docs: DataFrame, templates: Sequence[Template], **columns) -> tuple[dict[bytes, int], int]:
    """Document frequency of each template word over all documents, and the number of documents.

    At most one row per template word comes to the driver.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        return {"words": [sorted(vocabulary.intersection(words_of(t))) + [b""] for t in texts]}

    found = map_texts(docs, work, "words array<binary>", **columns).select(F.explode("words").alias("word"))
    counted = {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counted, counted.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, *, rare_words: int = 3, min_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, matches array<struct<label, base, start, score>>) of every whole text, matches by start then label.

    score is the share of the template's words found at the place; places under `min_share`
    are dropped. Null and empty texts have no words and no matches. One row per input row,
    repeated ones too; other columns may have any name.
    """
    frequency, total = licence_word_counts(docs, templates, id_col=id_col, text_col=text_col)
    index = RareWordIndex(templates, frequency, total, rare_words)

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        sizes, found = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            hits = [(s, index.templates[k].label, index.templates[k].base, share) for k, s, share in index.matches(words) if share >= min_share]
            found.append([{"label": label, "base": base, "start": max(0, s), "score": share} for s, label, base, share in sorted(set(hits))])
        return {"n_words": sizes, "matches": found}

    return map_texts(docs, work, "n_words long, matches array<struct<label: string, base: boolean, start: long, score: double>>", id_col=id_col, text_col=text_col)
