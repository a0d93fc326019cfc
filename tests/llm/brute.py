"""Plain Python versions of the corpus operators' contracts, for small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None, width: int) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near(texts: dict, width: int, percent: int) -> dict:
    """id -> (set size, smallest id reachable)."""
    sets = {d: shingle_set(t, width) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(texts: dict, window: int) -> dict:
    """id -> (words, removed, digest of what is kept)."""
    count: collections.Counter = collections.Counter()
    split = {d: WORD.findall(t or "") for d, t in texts.items()}
    for w in split.values():
        count.update(" ".join(w[k : k + window]) for k in range(len(w) - window + 1))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[" ".join(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]


def pii(text: str | None) -> list[tuple]:
    return sorted((m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(PII) for m in pattern.finditer(text or "") if ok(m.group()))


def warc(pages: list[tuple]) -> dict:
    """id -> (bytes, digest, type, refers_to)."""
    first: dict = {}
    for i, t in sorted(pages):
        first.setdefault(t or "", i)
    out = {}
    for i, t in pages:
        b = (t or "").encode()
        f = first[t or ""]
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    return out


def cosine_links(rows: list[tuple], least: float) -> dict:
    """id -> (links, smallest id reachable) for (id, vector, label)."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / np.abs(np.array(v, float)).max()
        return v / np.linalg.norm(v)

    good = [(i, unit(v), g) for i, v, g in rows]
    links = collections.defaultdict(set)
    for k, (i, v, g) in enumerate(good):
        for j, w, h in good[k + 1 :]:
            if v is not None and w is not None and g is not None and g == h and len(v) == len(w) and float(v @ w) >= least:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen))
    return out


def line_key(line: str) -> str:
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)


def lines(texts: list[tuple], min_chars: int, min_docs: int) -> list[tuple]:
    """(id, lines, dropped, kept text) of each (id, text) row, in order; an id of None is the smallest."""
    holders = collections.defaultdict(list)
    for i, t in texts:
        for key in {line_key(x) for x in (t or "").split("\n")}:
            holders[key].append(i)
    out = []
    for i, t in texts:
        split = (t or "").split("\n")
        gone = []
        for x in split:
            key = line_key(x)
            ids = [j for j in holders[key] if j is not None]
            gone.append(len(key) >= min_chars and len(holders[key]) >= min_docs and bool(ids) and max(ids) != i)
        out.append((i, len(split), sum(gone), "\n".join(x for x, g in zip(split, gone) if not g)))
    return out


def runs(w: list[str], least: int) -> list[tuple]:
    """(start, length, period) of all runs of a list of words, by start and period."""
    found: dict = {}
    for q in range(1, len(w) // 2 + 1):
        start = 0
        for z in range(len(w) - q + 1):
            if z == len(w) - q or w[z] != w[z + q]:
                if z - start >= q and z + q - start >= least:
                    found.setdefault((start, z + q - start), q)  # periods come in order, so a multiple is not entered
                start = z + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], found: list[tuple]) -> str:
    gone = set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    return " ".join(x for k, x in enumerate(w) if k not in gone)
