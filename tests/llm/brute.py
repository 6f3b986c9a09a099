"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text: str | None) -> set:
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(texts: dict, percent: int = 80) -> dict:
    """id -> (number of shingles, smallest id it reaches)."""
    sets, low = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def hits(text: str | None, items: dict, window: int = 10) -> tuple[int, int, list]:
    """(words, hit words, items) of a text."""
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items.items():
        own = PLAIN_WORD.findall((t or "").translate(LOWER))
        n = min(window, len(own))
        for g in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == g:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


class Katz:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts: list, order: int, largest: int = 5):
        self.order, self.largest = order, largest
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            pad = ["\t"] * (order - 1) + self.tokens(t)
            for i in range(order - 1, len(pad)):
                for m in range(1, order + 1):
                    self.counts[m][tuple(pad[i - m + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.kept = [None, *[self.discount(c) for c in self.counts[1:]]]
        self.unseen = sum(c - self.keep(c, 1) for c in self.counts[1].values()) / self.n if self.n else 1.0
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for m in range(2, order + 1):
            for g in self.counts[m]:
                self.after[m][g[:-1]].append(g)

    @staticmethod
    def tokens(text: str | None) -> list[str]:
        return [*SPACE_WORD.findall((text or "").translate(LOWER)), "\n"]

    def discount(self, counts: Counter) -> list[float]:
        k, n = self.largest, Counter(counts.values())
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        kept = [0.0]
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common != 1 else 0
            kept.append(r * d if 0 < d < 1 else r - 0.5)
        return kept

    def keep(self, c: int, m: int) -> float:
        return self.kept[m][c] if c <= self.largest else c - (self.largest - self.kept[m][-1])

    def p(self, context: tuple, word: str) -> float:
        m = len(context) + 1
        c = self.counts[m][(*context, word)]
        if m == 1:
            return self.keep(c, 1) / self.n if c else self.unseen
        total = sum(self.counts[m][g] for g in self.after[m].get(context, ()))
        if c:
            return self.keep(c, m) / total
        if not total:
            return self.p(context[1:], word)
        seen = self.after[m][context]
        lost = sum(self.counts[m][g] - self.keep(self.counts[m][g], m) for g in seen) / total
        return lost / (1 - sum(self.p(context[1:], g[-1]) for g in seen)) * self.p(context[1:], word)

    def score(self, text: str | None) -> float:
        pad = ["\t"] * (self.order - 1) + self.tokens(text)
        return sum(math.log10(self.p(tuple(pad[i - self.order + 1 : i]), pad[i])) for i in range(self.order - 1, len(pad)))

    def base(self, text: str | None) -> float:
        return sum(math.log10((self.counts[1][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in self.tokens(text))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


M64 = (1 << 64) - 1


def term_feature(data: bytes, mark: int = 0, bits: int = 20) -> int:
    """A term's bytes as a polynomial, mixed."""
    x = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(data)) & M64 ^ mark
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return (x ^ x >> 31) >> (64 - bits)


def toxic_features(text: bytes) -> Counter:
    out: Counter = Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text):
        w = w.lower()
        out[term_feature(w)] += 1
        if len(w) > 5:
            out[term_feature(w[:5], 0x5DEECE66D)] += 1
    return out


def toxicity(rows: list, labels: dict, nearest: int = 50) -> list:
    """(doc_id, score, evidence, cosines) by all cosines; few enough labels that all are examples."""
    import numpy as np
    import xxhash

    from shelfcast.llm.toxicity import isotonic

    counts = [toxic_features((t or "").encode()) for _, t in rows]
    df = Counter(f for c in counts for f in c)

    def unit(c):
        v = {f: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[f])) + 1) for f, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    units = [unit(c) for c in counts]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    known = [(k, labels[d], signed(t)) for k, (d, t) in enumerate(rows) if d in labels and t is not None]
    ones, zeros = (sum(1 for _, y, h in known if h % 5 and y == o) for o in (1, 0))
    rate = ones / (ones + zeros)
    examples = [(k, y, h) for k, y, h in known if h % 5 and counts[k]]
    examples.sort(key=lambda x: (min(f for f, n in counts[x[0]].items() if n == max(counts[x[0]].values())), x[2], rows[x[0]][0]))

    def vote(k):
        cos = [(round(sum(w * units[e].get(f, 0) for f, w in units[k].items()), 12), p) for p, (e, _, _) in enumerate(examples)]
        best = sorted((c for c in cos if c[0] > 0), key=lambda c: (-round(c[0], 9), c[1]))[:nearest]
        total = sum(c for c, _ in best)
        got = (sum(c * examples[p][1] for c, p in best) + 2 * rate) / (total + 2)
        return got, [rows[examples[p][0]][0] for _, p in best[:3]], [c for c, _ in best[:3]]

    held = sorted((vote(k)[0], y) for k, y, h in known if not h % 5 and counts[k])
    steps = isotonic(np.array([v for v, _ in held]), np.array([float(y) for _, y in held]), np.ones(len(held)))
    off = 0.5 / (len(held) + 1)
    levels = [0.0, *steps[0], 1.0], [0.0, *[off + (1 - 2 * off) * v for v in steps[1]], 1.0]
    votes = [vote(k) for k in range(len(rows))]
    return [(d, float(np.interp(v, *levels)), e, c) for (d, _), (v, e, c) in zip(rows, votes, strict=True)]
