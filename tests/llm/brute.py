"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UP = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(_UP))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    """doc_id -> least doc_id that links reach; docs: [(doc_id, text)]."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i, _ in docs}


def host_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32])


def redact(text, spans):
    out, at, end = [], 0, -1
    for s, _, e in sorted(spans):
        if s > end:
            out += [text[at:s] if end < 0 else text[end:s], "[secret]"]
            end = e
        end = max(end, e)
    return "".join(out) + text[end:] if spans else text


def mixture(docs):
    """[(doc_id, size, source_size, target, taken)]; docs: [(doc_id, text, source)]."""
    size = [(i, len(WORD.findall(t or "")), s) for i, t, s in docs]
    key = {(i, n, s): str(i) if i is not None else "text " + hashlib.md5((t or "").encode()).hexdigest() for (i, n, s), (_, t, _) in zip(size, docs, strict=True)}
    sums = defaultdict(int)
    for _, n, s in size:
        sums[s] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = sum(sums.values())
    target, free = {}, set(names)
    while free:  # share, cap what is above, share the rest again
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sums[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(3 * sums[s]) for s in above}
        free -= above
    whole = {s: int(target[s] + 1e-6) for s in names}
    out = []
    for s in names:
        at = 0
        for i, n, _ in sorted((x for x in size if x[2] == s), key=lambda x: (hashlib.md5(key[x].encode()).hexdigest(), x[0] or 0, x[1])):
            taken = sum(max(0, min(at + e * sums[s] + n, whole[s]) - at - e * sums[s]) for e in range(3))
            out.append((i, n, sums[s], target[s], taken))
            at += n
    return out


def slots(targets, n, multiplier=2654435769):
    """Owner of each of the first n slots; targets: [(source, words)] in order."""
    whole = [(s, int(t + 1e-6)) for s, t in targets if int(t + 1e-6)]
    every, at, arcs = sum(t for _, t in whole), 0, []
    for s, t in whole:
        arcs.append((s, int(at * 4294967296.0 / every), int((at + t) * 4294967296.0 / every)))
        at += t
    return [next(s for s, low, high in arcs if low <= i * multiplier % 2**32 < high) for i in range(n)]


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(_UP), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict
