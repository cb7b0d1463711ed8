"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i, n=5):
    return zlib.crc32(str(i).encode()) % n


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def base_lm(rows):
    """doc_id -> (held_out, n_tokens, n_known, N, base_score) and the training counts."""
    import math

    end = object()
    count = Counter()
    tokens = {i: WORD.findall(lower(t or "")) + [end] for i, t in rows}
    for i, w in tokens.items():
        if fold(i) != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return {i: (fold(i) == 1, len(w), sum(1 for x in w if count[x]), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}, count


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {p for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def shingles(t, k):
    w = WORD.findall(lower(t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1))


def near(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in index[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (keep(groups[t or ""]), len(groups[t or ""]), sha(t or "")) for i, t in rows}


def line_runs(rows, min_words):
    """doc -> indexes of lines inside a run of min_words words whose first window occurred earlier, extended
    along the first place of that window."""
    docs = {}
    for i, t in sorted(rows):
        ls = (t or "").split("\n")
        docs[i] = [(x, len(WORD.findall(x)), k) for k, x in enumerate(ls) if WORD.search(x)]
    first, gone = {}, defaultdict(set)
    for i, ls in docs.items():
        for a in range(len(ls)):
            n, b = 0, a
            while b < len(ls) and n < min_words:
                n += ls[b][1]
                b += 1
            if n < min_words:
                continue
            key = tuple(x[0] for x in ls[a:b])
            if key not in first:
                first[key] = (i, a)
                continue
            j, c = first[key]
            other = docs[j]
            lo, hi = a, b
            while lo > 0 and c - (a - lo) > 0 and ls[lo - 1][0] == other[c - (a - lo) - 1][0]:
                lo -= 1
            while hi < len(ls) and c + (hi - a) < len(other) and ls[hi][0] == other[c + (hi - a)][0]:
                hi += 1
            gone[i].update(x[2] for x in ls[lo:hi])
    return {i: sorted(gone[i]) for i in docs if gone[i]}


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out)


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def spans_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
