"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re

import xxhash


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows, far=2):
    """rows: (id, fingerprint); id -> smallest id reachable."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if (x ^ y).bit_count() <= far and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


LICENCE_BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licences(text):
    """(n_words, starts, labels) of the base phrases."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_az(text))
    starts, labels = [], set()
    for phrase, label in LICENCE_BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), sorted(starts), ",".join(sorted(labels))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), list(PII).index(k), k, m.end()) for k in PII for m in re.finditer(PII[k], text or "") if good(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def bad_hosts(counts, ratio=1.25):
    """Hosts whose failure rate exceeds the bound with 95 %; counts: host -> (failed, n)."""
    raw = [f / n for f, n in counts.values()]
    mean = sum(raw) / len(raw)
    v = sum((x - mean) ** 2 for x in raw) / len(raw) - mean * (1 - mean) * sum(1 / n for _, n in counts.values()) / len(counts)
    strength = min(max(mean * (1 - mean) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    bad = set()
    for h, (f, n) in counts.items():
        rate = (f + mean * strength) / (n + strength)
        if rate - 1.645 * (rate * (1 - rate) / (n + strength + 1)) ** 0.5 > ratio * mean:
            bad.add(h)
    return bad


def kept_by_quality(rows, ratio=1.25):
    """Ids that the quality rules keep; rows: id -> (measures, text, host)."""
    hard = {d: m[0] < 20 or 100 * m[4] > 30 * m[0] for d, (m, *_) in rows.items()}
    soft = {}
    for d, (m, t, _) in rows.items():
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        soft[d] = 10 * m[2] > m[0] or 10 * m[3] > 3 * lines or m[1] < 2 * m[0] or m[1] > 12 * m[0]
    of = {}
    for d, (_, _, host) in rows.items():
        of.setdefault(host, []).append(hard[d] or soft[d])
    bad = bad_hosts({h: (sum(x), len(x)) for h, x in of.items()}, ratio)
    return {d for d, (_, _, host) in rows.items() if not hard[d] and not (host in bad and soft[d])}


def top_k(rows, k=10, every=100):
    """rows: (id, vector); best rows of each query row, as (query, rank, id, score)."""
    import math

    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(usable):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(usable) if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def mixed_slots(weights):
    """Earliest deadline first over one frame; weights: key -> m. Slot -> key."""
    w, taken, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(w):
        ready = [(((taken[k] + 1) * w + m - 1) // m, k) for k, m in sorted(weights.items()) if taken[k] < m and taken[k] * w // m <= t]
        key = min(ready)[1]
        taken[key] += 1
        out.append(key)
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
