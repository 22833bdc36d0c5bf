"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def luhn(digits):
    values = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def removed(texts, length):
    """(bytes, removed bytes, runs, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        cover, end = [], 0
        for k in range(len(d)):
            if k <= len(d) - length and seen[d[k : k + length]] > 1:
                end = k + length
            cover.append(k < end)
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        runs = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(d), len(d) - len(kept), runs, kept))
    return out


def shingles(text, size):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def components(rows, size, percent):
    """id -> smallest id reachable over links of at least ``percent``."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def kept_lines(rows, ratio, least):
    """id -> text without the boilerplate lines of its host; rows: (id, host, text)."""
    pages, hosts = Counter(), Counter(h for _, h, _ in rows)
    for _, h, t in rows:
        pages.update({(h, x) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in pages.items() if n >= least and n / hosts[k[0]] >= ratio}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for i, h, t in rows}


def best_fit_decreasing(lengths, capacity):
    """Sequences that plain best-fit decreasing over all pieces needs."""
    free, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(free, n)
        if at < len(free):
            room = free.pop(at)
        else:
            room, used = capacity, used + 1
        insort(free, room - n)
    return used


def graph_scores(edges, rounds, support, least):
    """{(pattern, instance): (confidence, score)} of (pattern, instance, seed) edges."""
    seed = {i: False for _, i, _ in edges}
    for _, i, s in edges:
        seed[i] = seed[i] or s
    score, confidence = {i: float(s) for i, s in seed.items()}, {}
    for _ in range(rounds):
        for p in {p for p, _, _ in edges}:
            own = [score[i] for q, i, _ in edges if q == p]
            confidence[p] = sum(own) / (len(own) + 1) if sum(s >= least for s in own) >= support else 0.0
        for i in seed:
            doubt = 1.0
            for p, j, _ in edges:
                doubt *= 1 - confidence[p] if j == i else 1
            score[i] = 1.0 if seed[i] else 1 - doubt
    return {(p, i): (confidence[p], score[i]) for p, i, _ in edges}
