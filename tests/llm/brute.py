"""Plain restatements of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def suffix_dedup(rows, length):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - length + 1):
                count[b[p : p + length]] += 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if count[b[p : p + length]] > 1:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(rows, length):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (i, p))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - length + 1):
                if first[tuple(w[p : p + length])] < (i, p):
                    gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_duplicates(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holds = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holds[x].append(k)
    pairs = Counter()
    for ks in holds.values():
        for a in range(len(ks)):
            for b in range(a):
                pairs[ks[b], ks[a]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(sets[a][0]), find(sets[b][0])
            root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


PLAIN = re.compile(r"[^\W_]+")


def tiling(item, doc, least):
    """Greedy string tiling word by word: the longest unmarked match first, ties by start."""
    used_i, used_d, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and not used_i[p + n] and not used_d[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        used_i[p : p + n] = used_d[t : t + n] = [True] * n
        tiles.append((p, t, n))


def decontaminate(rows, items, coverage, least=5):
    split = lambda t: PLAIN.findall((t or "").lower())
    out = []
    for i, text in rows:
        found = []
        for k, item in items:
            w = split(item)
            if i is not None and k is not None and len(w) >= least:
                share = sum(n for *_, n in tiling(w, split(text), least)) / len(w)
                if share >= coverage:
                    found.append((share, -k))
        top = max(found, default=None)
        out.append((i, bool(found), not found, len({k for _, k in found}), -top[1] if top else None, top[0] if top else 0.0))
    return out


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


BASE = [
    (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
ALLOWED = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^sha(1|256|384|512)-|(?i:example)")


def secret_spans(text):
    """(start, kind, end) of base spans and of windows of 20 characters with high entropy."""
    base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))
    added = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        w = m[0]
        if not re.search("[A-Za-z]", w) or ALLOWED.search(w):
            continue
        least = 3.8 if not re.search("[0-9]", w) else 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 3.8 if re.search("[A-Z]", w) else 3.7
        entropy = lambda x: -sum(n / 20 * math.log2(n / 20) for n in Counter(x).values())
        hot = [i for i in range(len(w) - 19) if entropy(w[i : i + 20]) >= least - 1e-9]
        if hot:
            a, b = m.start() + hot[0], m.start() + hot[-1] + 20
            if not any(x <= a and b <= y for x, _, y in base):
                added.append((a, 3, b))
    return base, added


def redact(text, mark="[secret]"):
    out, at = "", 0
    base, added = secret_spans(text)
    for a, _, b in sorted(base + added):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def language_kept(words, p, pieces, langs, gain, unknown):
    """Whether a text is kept, by a forward sum word by word; the last column of p is the background."""
    longest = max(map(len, pieces))
    total = [0.0] * (len(langs) + 1)
    for w in words:
        w = "▁" + w
        for k in range(len(langs) + 1):
            a = [1.0] + [0.0] * len(w)
            for end in range(1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    i = pieces.get(w[start:end])
                    a[end] += a[start] * (p[i][k] if i is not None else unknown if end - start == 1 else 0.0)
            total[k] += math.log(a[-1])
    best = max(total[:-1])
    return 1 / sum(math.exp(t - best) for t in total[:-1]) >= 0.5 and best - total[-1] >= gain * sum(map(len, words))
