"""Katz scores by dictionaries of words, for tables that fit in memory."""

import math
import zlib
from collections import Counter, defaultdict

END, BEGIN, RARE = ("end",), ("begin",), ("rare",)


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def discounts(n):
    top = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    def __init__(self, texts, vocabulary):
        uni = Counter(w for t in texts for w in tokens(t))
        self.uni, self.n, self.v = uni, sum(uni.values()), len(uni)
        least = next((c for c in sorted(set(uni.values())) if sum(x >= c for x in uni.values()) <= vocabulary), math.inf)
        known = {w: c for w, c in uni.items() if c >= least}
        d = discounts(Counter(uni.values()))
        self.p = {w: d.get(c, 1.0) * c / self.n for w, c in known.items()}
        left = 1 - sum(self.p.values())
        if left <= 1e-12:
            left = 1 / (self.n + 1)
            total = sum(self.p.values())
            self.p = {w: x * (1 - left) / total for w, x in self.p.items()}
        self.p[RARE] = left
        self.rare_n, self.rare_v = self.n - sum(known.values()), self.v - len(known)
        self.bi = Counter(x for t in texts for x in self.pairs(t))
        self.d = discounts(Counter(self.bi.values()))
        self.after = defaultdict(dict)
        for (h, w), c in self.bi.items():
            self.after[h][w] = c

    def word(self, w):
        return w if w in self.p else RARE

    def pairs(self, text):
        ids = [self.word(w) for w in tokens(text)]
        return list(zip([BEGIN, *ids], ids, strict=False))

    def given(self, h):
        """The distribution after h over the known words and the rare class."""
        seen, total = self.after.get(h, {}), sum(self.after.get(h, {}).values())
        if not seen:
            return dict(self.p)
        q = {w: self.d.get(c, 1.0) * c / total for w, c in seen.items()}
        unseen = 1 - sum(self.p[w] for w in seen)
        if unseen <= 1e-12:
            s = sum(q.values())
            return {w: x / s for w, x in q.items()}
        if 1 - sum(q.values()) <= 1e-12:
            s = sum(q.values())
            q = {w: x / s * total / (total + 1) for w, x in q.items()}
        alpha = (1 - sum(q.values())) / unseen
        return {w: q[w] if w in q else alpha * x for w, x in self.p.items()}

    def score(self, text):
        out = 0.0
        for w, (h, x) in zip(tokens(text), self.pairs(text), strict=True):
            out += math.log10(self.given(h)[x])
            if x == RARE:
                out += math.log10((self.uni[w] + 0.5) / (self.rare_n + 0.5 * (self.rare_v + 1)))
        return out

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in tokens(text))


def fold(key, folds=10):
    return None if key is None else zlib.crc32(str(key).encode()) % folds
