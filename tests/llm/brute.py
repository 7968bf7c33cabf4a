"""Slow, plain versions of what the text operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, len(lines) - len(set(lines)), len(covered)


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, k, percent):
    """``id: (set size, component)`` of ``(id, text)`` rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = roots(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def personal(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def trie(rows: list[tuple]) -> list[tuple]:
    """Nodes of rebuilt conversations ``(conv, turn, role, text)``, from all beginnings of all of them."""
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members: dict[tuple, list[int]] = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault((whole[:d], len(whole) == d), []).append(c)
    nodes = {p for p, _ in members}
    convs = {p: sorted(members.get((p, True), []) + members.get((p, False), [])) for p in nodes}
    out = []
    for p in nodes:
        below = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in below if q}
        saved = sum((len(convs[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = hashlib.sha256(",".join(map(str, sorted(members.get((p, True), [])))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in below)
        parent = convs[p[:-1]][0] if p else None
        out.append((convs[p][0], len(p), parent, len(convs[p]), children, sum(q not in inner for q in below), saved, ends))
    return sorted(out)
