"""Plain Python versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def license_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def gram_hash(gram, n, bits):
    h = n
    for c in gram:
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << bits) - 1)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(rows, percent, n=5):
    """rows: (doc_id, text) -> {doc_id: component}."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def katz(rows, held, r_max=5, reserve=0.01):
    """rows: (doc_id, text) -> {doc_id: (n_tokens, n_known, base, score)}, total, sums of some contexts; recursion per token."""
    seqs = {i: [*words(t), "\n"] for i, t in rows}
    grams, after = [None, Counter(), Counter(), Counter()], defaultdict(set)
    for i, s in seqs.items():
        if not held(i):
            s = ["\n", *s]
            for at in range(1, len(s)):
                for n in range(1, min(3, at + 1) + 1):
                    gram = tuple(s[at - n + 1 : at + 1])
                    grams[n][gram] += 1
                    after[gram[:-1]].add(gram[-1])

    def factors(counts):
        n = Counter(counts.values())
        common = (r_max + 1) * n[r_max + 1] / n[1] if n[1] else 1
        d = {}
        for r in range(1, r_max + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        return d

    d = [None, *(factors(g) for g in grams[1:])]
    one = {w: c for (w,), c in grams[1].items()}
    N, V = sum(one.values()), len(one)

    def seen(h, w):
        c = grams[len(h) + 1][(*h, w)]
        return d[len(h) + 1].get(c, 1) * c / ((grams[len(h)][h] if h else N) + reserve)

    unknown = 1 - sum(seen((), w) for w in one)
    alphas = {}

    def alpha(h):
        if h not in alphas:
            alphas[h] = (1 - sum(seen(h, w) for w in after[h])) / (1 - sum(p(h[1:], w) for w in after[h]))
        return alphas[h]

    def p(h, w):
        if grams[len(h) + 1][(*h, w)]:
            return seen(h, w)
        if not h:
            return unknown
        return alpha(h) * p(h[1:], w) if after.get(h) else p(h[1:], w)

    out = {}
    for i, s in seqs.items():
        base = sum(math.log10((one.get(w, 0) + 0.5) / (N + 0.5 * (V + 1))) for w in s)
        before = ["\n", *s]
        score = sum(math.log10(p(tuple(before[max(0, at - 1) : at + 1]), w)) for at, w in enumerate(s))
        out[i] = (len(s), sum(w in one for w in s), base, score)
    contexts = [h for h in list(after) if h][:: max(1, len(after) // 50)]
    total = {h: sum(p(h, w) for w in [*one, None]) for h in contexts}
    return out, N, total


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    """[(start, kind rank, kind, end)] of the base contract."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)
