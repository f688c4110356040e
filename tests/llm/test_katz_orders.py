"""Katz backoff of any order against dictionaries, and against the compact form for order two."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from subsidia.llm import katz, katz_orders
from tests.llm import katz_brute
from tests.llm.katz_brute import BEGIN, RARE, discounts, fold, tokens
from tests.llm.messy import ROWS, both


class Brute:
    """Whole distributions after each history, by recursion over orders."""

    def __init__(self, texts, order):
        self.words = katz_brute.Model(texts, math.inf)
        self.order, self.d, self.after = order, {}, {}
        for n in range(2, order + 1):
            counts = Counter(g for t in texts for g in self.grams(t, n))
            self.d[n], self.after[n] = discounts(Counter(counts.values())), defaultdict(dict)
            for g, c in counts.items():
                self.after[n][g[:-1]][g[-1]] = c

    def grams(self, text, n):
        line = [BEGIN] * (n - 1) + tokens(text)
        return [tuple(line[i : i + n]) for i in range(len(line) - n + 1)]

    def given(self, history):
        lower = self.given(history[1:]) if history else self.words.p
        n = len(history) + 1
        seen = self.after[n].get(history) if history else None
        if not seen:
            return lower
        total = sum(seen.values())
        q = {w: self.d[n].get(c, 1.0) * c / total for w, c in seen.items()}
        if 1 - sum(q.values()) <= 1e-12:
            q = {w: x * total / (total + 1) for w, x in q.items()}
        alpha = (1 - sum(q.values())) / (1 - sum(lower[w] for w in seen))
        return {w: q[w] if w in q else alpha * x for w, x in lower.items()}

    def score(self, text):
        return sum(math.log10(self.given(g[:-1])[g[-1] if g[-1] in self.words.uni else RARE]) for g in self.grams(text, self.order))


def corpora():
    rnd = random.Random(5)
    words = ["a", "b", "the", "OF", *(f"x{i}" for i in range(60))]
    mixed = [(i, " ".join(rnd.choice(words[: rnd.choice((3, 5, 64))]) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    hot = [(i, "hot " * 30 + f"w{i % 7} hot x") for i in range(40)]
    return mixed + [(1000, None), (1001, ""), (1002, "zz q a b")], hot, [(i, "a b a b") for i in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(spark, monkeypatch, order):
    for rows, hot in zip(corpora(), (1 << 17, 8, 1), strict=True):
        monkeypatch.setattr(katz_orders, "HOT", hot)
        model = Brute([t for i, t in rows if fold(i)], order)
        for after in model.after.values():
            assert all(abs(sum(model.given(h).values()) - 1) < 1e-9 for h in after)
        got = {r.doc_id: r for r in katz_orders.ngram_scores(spark.createDataFrame(rows, "doc_id long, text string"), order).collect()}
        assert got.keys() == dict(rows).keys()
        for i, t in rows:
            assert np.allclose([got[i].score, got[i].base_score], [model.score(t), model.words.base(t)], rtol=1e-9)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(w in model.words.uni for w in tokens(t)), model.words.n)
            assert got[i].held_out == (fold(i) == 0)


def test_order_two_is_the_compact_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    got = {r.doc_id: r for r in katz_orders.ngram_scores(docs, 2).collect()}
    assert got.keys() == want.keys()
    for k, a in want.items():
        assert a[:5] == got[k][:5] and np.allclose(a[5:], got[k][5:], rtol=1e-9)


def test_edges(spark):
    rows = both(spark, katz_orders.ngram_scores, lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    assert sorted(r.n_tokens for r in rows) == sorted(len(tokens(t)) for _, t in ROWS)
    alone = katz_orders.ngram_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (alone.held_out, alone.train_tokens, alone.n_known, alone.score, alone.base_score) == (False, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        katz_orders.ngram_scores(spark.createDataFrame(rows), 0)
