import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from subsidia.llm import runs
from tests.llm.messy import LONG, both, documents


def brute(words, least=6, periods=4):
    """Runs by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smallest = not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q))
            if smallest and length >= max(least, periods * q):
                found.append((i, length, q))
            i = j
    return sorted(found)


def ids(words):
    own = {}
    return np.array([own.setdefault(w, len(own)) for w in words], dtype=np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_small_alphabets(words):
    for least, periods in ((6, 4), (2, 2), (6, 3)):
        assert runs.find_runs(ids(words), least, periods) == brute(words, least, periods)


def test_runs_of_planted_repeats():
    rng = random.Random(3)
    for _ in range(150):
        words = []
        while len(words) < 120:
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            words += root * rng.randrange(1, 7) + root[: rng.randrange(len(root))]
        assert runs.find_runs(ids(words)) == brute(words)
        assert runs.find_runs(ids(words), 2, 2) == brute(words, 2, 2)


def test_arrays():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (50, 2), (300, 3), (300, 1), (300, 200)):
        words = rng.integers(0, letters, size)
        sa, inverse = runs.suffix_array(words)
        assert sa.tolist() == sorted(range(size), key=lambda i: words[i:].tolist()) and (inverse[sa] == np.arange(size)).all()
        ext = runs.Extensions(words)
        i, j = rng.integers(0, size, 200), rng.integers(0, size + 1, 200)
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(size) if max(a, b) + k >= size or words[a + k] != words[b + k]), 0) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert ext.common(i, j).tolist() == want


def test_long_periodic_texts():
    assert runs.find_runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    words = np.r_[np.tile(np.arange(1000), 5), 5000, np.arange(3000)]
    assert runs.find_runs(words) == [(0, 5000, 1000)]


def expected(key, text):
    """The row of op13 by the definition."""
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def query(df):
    return runs.run_digests(runs.periodic_runs(runs.with_periods(df)))


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").collect()
    drawn = [(k, t) for k, t in rows] + [(10_000 + i, t) for i, (_, t) in enumerate(rows)] + [(7, "a b " * 20 + "c"), (8, "x x x x x x y y y y y y z"), (9, "\x0bA a A a A a A a A\x0c")]
    df = spark.createDataFrame(drawn, "doc_id long, text string")
    got = [tuple(r) for r in query(df).collect()]
    assert sorted(got) == sorted(expected(*r) for r in drawn)
    assert sum(r[1] > 0 for r in got) > 20


def test_awkward_rows(spark):
    got = both(spark, query, str)
    assert len(got) == len(documents(spark).collect())
    rows = {r["doc_id"]: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    for k in (1, 2, 3):
        assert (rows[k]["n_runs"], rows[k]["start"], rows[k]["runs_sha256"], rows[k]["collapsed_sha256"]) == (0, None, empty, empty)
    assert (rows[7]["start"], rows[7]["length"], rows[7]["period"], rows[7]["exponent_milli"]) == (0, 30_000, 1, 30_000_000)
    found = runs.periodic_runs(documents(spark).where("doc_id = 7")).first()
    assert found["collapsed"] == "word " + " ".join(LONG.split()[30_000:]) and found["n_words"] == 30_002


def test_periodic_tails(spark):
    text = " ".join(f"w{i}" for i in range(500))
    keys = [k for k in range(300) if zlib.crc32(str(k).encode()) % 10 == 0]
    for k, changed in runs.with_periods(spark.createDataFrame([(k, text) for k in keys], "doc_id long, text string")).collect():
        g = zlib.crc32(str(k).encode()) // 10
        a = g % 500
        p = 1 + (500 - a) // (3 + g % 8)
        assert changed.split() == [f"w{i if i < a else a + (i - a) % p}" for i in range(500)]
