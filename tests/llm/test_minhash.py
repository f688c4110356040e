import random
from collections import Counter, defaultdict

import numpy as np

from subsidia.llm import minhash
from subsidia.llm.components import components
from tests.llm.messy import ROWS, both, documents


def brute(rows, k=5):
    """{id: (set size, least id reachable)} through all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rnd.choices(words, k=rnd.randint(3, 160)) for _ in range(25)]
    passage = rnd.choices(words, k=60)
    for i in range(420):
        w = list(rnd.choice(base)) if i % 6 else rnd.choices(words, k=80) + passage
        for _ in range(rnd.choice((0, 0, 1, 2, 4, 9))):
            j = rnd.randrange(len(w) + 1)
            w[j : j + rnd.randint(0, 1)] = [rnd.choice(words)]
        rows.append((i * 7 % 421, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_loose_copies_equal_brute_force(spark, monkeypatch):
    """Groups whose members lie about the threshold from each other, so that many components share buckets."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(3):
        base = rnd.choices(words, k=120)
        for i in range(160):
            w = list(base)
            for j in rnd.sample(range(120), (2, 3, 4)[g]):
                w[j] = f"own{g}x{i}x{j}" if rnd.random() < 0.7 else rnd.choice(words)
            rows.append((1000 * g + (i * 37) % 160, " ".join(w)))
    want = brute(rows)
    assert 3 < len({root for _, root in want.values()}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").persist()
    for shingles in (1_000_000, 2_000):
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == want


def test_peeling_keeps_every_set_with_a_link(spark, monkeypatch):
    """What is peeled off has no link to another root; a group that is too loose goes, though its sets share three quarters."""
    rnd = random.Random(4)
    sets, root = {}, {}
    for g in range(6):
        base = rnd.sample(range(1000 * g, 1000 * g + 900), 120)
        for i in range(40):
            lost = rnd.randint(1, 40)
            sets[100 * g + i] = set(rnd.sample(base, 120 - lost)) | {10**6 + rnd.randrange(10**9) for _ in range(rnd.randint(0, lost))}
    for i in range(600, 640):  # 20 % of each set is its own: in no other set, and more than a seventh
        sets[i] = set(range(-100, 0)) | {10**12 * i + j for j in range(25)}
    root = {i: i if i % 5 else i - i % 100 for i in sets}
    rest = spark.createDataFrame([(i // 100, i, root[i]) for i in sets], "bucket long, node long, root long")
    full = spark.createDataFrame([(i, np.array(sorted(x), dtype=np.int64).tobytes()) for i, x in sets.items()], "node long, shingles binary")
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1_000)
    kept = {r.node: r.n for r in minhash._able(rest, full, 75).collect()}
    need = {i for i in sets for j in sets if i // 100 == j // 100 and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert need and need <= set(kept) and all(kept[i] == len(sets[i]) for i in kept)
    assert not any(i >= 600 for i in kept) and len(kept) < len(sets) - 40


def test_peeling_reads_the_buckets_once(spark, monkeypatch):
    """However many rounds there are, the rows of the buckets are read and joined to sizes once; rounds read what is left."""
    seen, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    # chains: the end of each shares too little, and once it has gone the next one is the end
    sets = {100 * g + i: set(range(1000 * g + 10 * i, 1000 * g + 10 * i + 20)) for g in range(4) for i in range(12)}
    rows = [(b, i, i) for i in sets for b in (i // 100, 50 + i // 100)]
    rest = spark.createDataFrame(rows, "bucket long, node long, root long").mapInArrow(counted, "bucket long, node long, root long")
    full = spark.createDataFrame([(i, np.array(sorted(x), dtype=np.int64).tobytes()) for i, x in sets.items()], "node long, shingles binary")
    own = minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name: written.append(name) or own(df, name))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 10)
    assert minhash._able(rest, full, 75).count() == 0
    assert written.count("alive") >= 3 and seen.value == len(rows)


def test_one_of_each_row(spark):
    got = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(documents(spark, True)).collect()), key=str)
    want = dict.fromkeys(ROWS)
    del want[6, ROWS[6][1]], want[8, ROWS[8][1]]
    assert got == sorted(want, key=str) and len(got) == 12
    null = [(None, f"one two three four five six seven {'x' if i else 'X'}") for i in range(5)] + [(None, None)] * 3
    assert sorted(map(str, (r.text for r in minhash.one_of_each(documents(spark, rows=null)).collect()))) == ["None"] * 3 + [min(("one two three four five six seven x", "one two three four five six seven X"), key=lambda t: spark.sql(f"SELECT xxhash64('{t}')").first()[0])]
    assert minhash.one_of_each(documents(spark, True).limit(0)).count() == 0


def test_edges(spark):
    got = both(spark, minhash.near_duplicates, lambda r: (r.doc_id is None, r.doc_id, r.n_shingles))
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for k in (1, 2, 3) for r in by[k]] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert (by[4][0].n_shingles, by[6][0].component_id, by[6][0].kept, by[8][0].component_id) == (1, 5, False, 7)
    assert all(r.component_id is None and not r.kept for r in by[None])


def test_posterior_bound():
    assert minhash.least_matches(200, 75, 1e-8) < 150 < minhash.least_matches(200, 75, 0.6)
    rng = np.random.default_rng(1)
    # pairs at the threshold are hardly ever dropped
    need = {n: minhash.least_matches(n, 75, minhash.MISS) for n in range(40, 201, 40)}
    hits = rng.random((20_000, 200)) < 0.75
    assert all((hits[:, :n].sum(axis=1) >= m).all() for n, m in need.items())


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 300), (7, 3), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
