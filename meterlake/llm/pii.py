"""Operator 3: personal data by pattern, checksum and context.

Regular expressions propose spans. Validators confirm them: Luhn for cards, mod-97 for
IBANs, value ranges for addresses and social security numbers, digit counts for phones.
Context words near a span raise or lower its score; kinds of the method's own (iban, ssn) are
kept from `min_score` on, base kinds always.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed order of kinds: base kinds as the contract lists them, then the method's.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

# Patterns of the base kinds. Possessive quantifiers and the look-behind keep long runs
# linear; they match what the plain forms match, because a run that fails once fails from
# each of its later starts, too.
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words that make a kind likelier, and words that speak against any kind.
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "pay"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "transfer", "konto"},
    "ssn": {"ssn", "social", "security", "number"},
}
AGAINST = {"order", "invoice", "version", "isbn", "serial", "sku"}
_WORDS = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    """Luhn checksum of a string of ASCII digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether letters and digits of an IBAN leave 1 modulo 97 once the first four are moved to the end."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _spans(pattern: re.Pattern, ok: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0]))


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _ssn_ok(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _iban_ok(s: str) -> bool:
    bare = s.replace(" ", "")
    return 15 <= len(bare) <= 34 and mod97(bare)


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails,
    "ip": _spans(_IP, _ip_ok),
    "card": _spans(_CARD, lambda s: 14 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _spans(_PHONE, lambda s: 10 <= len(_digits(s)) <= 15),
    "iban": _spans(_IBAN, _iban_ok),
    "ssn": _spans(_SSN, _ssn_ok),
}
# Score before context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}


def score(kind: str, text: str, start: int, end: int, reach: int = 60) -> float:
    """Prior of the kind, moved by context words within `reach` characters on both sides."""
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    moved = PRIOR[kind] + 0.3 * bool(near & CONTEXT[kind]) - 0.2 * bool(near & AGAINST)
    return min(1.0, max(0.0, moved))


def find_spans(text: str, min_score: float = 0.5) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of a whole text, by start, then kind in the fixed order."""
    found = []
    digit = any(map(text.__contains__, "0123456789"))
    for kind, finder in FINDERS.items():
        if not ("@" in text if kind == "email" else digit):
            continue
        for start, end in finder(text):
            s = score(kind, text, start, end)
            if kind in BASE_KINDS or s >= min_score:
                found.append((start, kind, end, s))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def masked(text: str, spans: Sequence[tuple[int, str, int, float]]) -> str:
    """The text with each span, overlapping ones joined, replaced by the first kind in brackets."""
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "spans array<struct<kind: string, start: long, end: long, score: double>>"


def find_pii(docs: DataFrame, *, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, masked): personal data of every whole text, in code points with exclusive ends.

    A null text has no spans and stays null in `masked`; an empty one stays empty. One row
    per input row.
    """

    def work(texts: Sequence[bytes | None]) -> dict[str, Sequence]:
        spans, hidden = [], []
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            found = find_spans(text, min_score)
            spans.append([{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in found])
            hidden.append(None if raw is None else masked(text, found))
        return {"spans": spans, "masked": hidden}

    return map_texts(docs, work, f"{SPANS}, masked string", id_col=id_col, text_col=text_col, pass_null=True)


def find_spans_only(docs: DataFrame, *, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): as `find_pii`, without the masked text."""

    def work(texts: Sequence[bytes]) -> dict[str, Sequence]:
        found = [find_spans(t.decode("utf-8", "replace"), min_score) for t in texts]
        return {"spans": [[{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in spans] for spans in found]}

    return map_texts(docs, work, SPANS, id_col=id_col, text_col=text_col)


def mask_documents(docs: DataFrame, *, min_score: float = 0.5) -> DataFrame:
    """All columns of `docs` with personal data in `text` masked and `n_chars`, if there, counted anew."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else masked(t, find_spans(t, min_score)))

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
