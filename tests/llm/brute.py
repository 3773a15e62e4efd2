"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LAST = 2**63 - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


def lower(text) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ordered(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


def sizes_and_targets(rows):
    """Sizes by row, totals and targets by source of (id, text, source)."""
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    goal, free, target = 1.5 * sum(total.values()), set(sources), {}
    while free:
        unit = goal / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else weight[s] * unit
        goal -= sum(target[s] for s in over)
        free = free - over if over else set()
    return sizes, total, target


def repeats(rows, length=50):
    docs = sorted(((LAST if i is None else i, i, (t or "").encode()) for i, t in rows), key=lambda d: d[0])
    first = {}
    for k, _, x in docs:
        for s in range(len(x) - length + 1):
            first.setdefault(x[s : s + length], k)
    out = []
    for k, i, x in docs:
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if first[x[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(x)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(x), sum(gone), spans, sha(bytes(c for c, g in zip(x, gone, strict=True) if not g))))
    return ordered(out)


def line_windows(rows, size=3):
    """Text left of each (id, text), equal rows being one."""
    docs = sorted(set(rows), key=lambda r: (LAST if r[0] is None else r[0], r[1] or ""))
    seen, left = {}, {}
    for i, t in docs:
        lines = (t or "").split("\n") if t else []
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if not any(x.strip(" \t\n\f\r") for x in w):
                continue
            if w in seen:
                gone.update(range(p, p + size))
            seen[w] = True
        left[(i, t)] = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
    return ordered((i, left[(i, t)]) for i, t in rows)


def near(rows, size=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    n = len(rows)
    link = [{j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9} for i in range(n)]
    label, key = {}, [LAST if i is None else i for i, _ in rows]
    for i in range(n):
        if i not in label:
            todo, group = [i], {i}
            while todo:
                new = link[todo.pop()] - group
                group |= new
                todo += new
            least = min(key[g] for g in group)
            label |= {g: None if least == LAST else least for g in group}
    return ordered((rows[i][0], label[i], len(link[i])) for i in range(n))


def windows(docs, items, size=10):
    owners = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[p : p + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(k) for k in owners}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in owners:
                    hit.update(range(p, p + n))
                    found |= owners[k]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return ordered(out)


ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
