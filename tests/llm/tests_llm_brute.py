"""Brute-force versions that several test modules use."""

import hashlib
import math
import re

from quillon.llm import quality



def shingles(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(docs, percent=85):
    """doc_id -> (shingles, component), through an inverted index of all shingles."""
    sets = [shingles(t) for _, t in docs]
    where, parent = {}, list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            where[x].append(k)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min((x for x in (i, low.get(find(k))) if x is not None), default=None)
    return [(i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(docs)]


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_alignments(docs, items):
    """(document, item) -> equal tokens of the best window and of its whole alignment; tokens beyond the document's edges differ."""
    out = {}
    parsed = [(j, words(t)) for j, t in items]
    for i, t in docs:
        x = words(t)
        for j, y in parsed:
            n, width = len(y), min(16, len(y))
            need = -(-13 * width // 16)
            for d in range(1 - n, len(x)) if n else ():
                same = [0 <= k + d < len(x) and x[k + d] == y[k] for k in range(n)]
                if sum(same) >= need:
                    best = max(sum(same[s : s + width]) for s in range(n - width + 1))
                    if best >= need:
                        out[i, j] = max(out.get((i, j), (0, 0)), (best, sum(same)))
    return out


def brute_leaks(docs, items):
    return set(brute_alignments(docs, items))


def brute_targets(sizes, weights, budget=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, budget * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def brute_plays(docs, target, schedules, epochs=2):
    """(doc_id, position, words) of every play of (doc_id, text, source): sources in hash order, times by bisection of the schedule's integral."""
    rows = []
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))

    def integral(knots, t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            x = min(max(t, a), b)
            total += (x - a) * (u + (u + (v - u) * (x - a) / (b - a))) / 2
        return total

    for turn, source in enumerate(sources):
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs if s == source)
        knots, size, start = schedules[turn % len(schedules)], sum(n for *_, n in mine), 0
        for _, i, n in mine:
            for e in range(epochs):
                at = start + e * size
                taken = min(n, int(target[source]) - at)
                if taken > 0:
                    want, low, high = at / target[source] * integral(knots, 1.0), 0.0, 1.0
                    for _ in range(60):
                        mid = (low + high) / 2
                        low, high = (mid, high) if integral(knots, mid) < want else (low, mid)
                    rows.append((i, high, taken))
            start += n
    return rows


def brute_quality(model, text):
    """A text's score, line by line: forward and backward sums over good and bad."""
    codes, size = quality.line_codes(text)
    n, place = len(codes), quality.PLACE
    own = lambda k: [int(c) + f * quality.BINS for f, c in enumerate(codes[k])] if 0 <= k < n else [place - 1] * len(quality.FEATURES)
    score = [math.exp(sum(model.weights[c + shift * place] for shift, j in enumerate((k, k - 1, k + 1)) for c in own(j))) for k in range(n)]
    move = [[math.exp(x) for x in row] for row in model.moves]
    emit = [(1.0, s) for s in score]
    ahead, behind = [None] * n, [(1.0, 1.0)] * n
    ahead[0] = (1.0, 1.0)
    norm = lambda p: (p[0] / sum(p), p[1] / sum(p))
    for k in range(1, n):
        ahead[k] = norm([sum(ahead[k - 1][a] * emit[k - 1][a] * move[a][b] for a in (0, 1)) for b in (0, 1)])
    for k in range(n - 2, -1, -1):
        behind[k] = norm([sum(move[a][b] * emit[k + 1][b] * behind[k + 1][b] for b in (0, 1)) for a in (0, 1)])
    p = [norm([ahead[k][y] * emit[k][y] * behind[k][y] for y in (0, 1)])[1] for k in range(n)]
    return sum(x * int(m) for x, m in zip(p, size)) / sum(map(int, size))
