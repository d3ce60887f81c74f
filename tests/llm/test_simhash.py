import random
from collections import defaultdict

import pytest
import xxhash

from meterloom.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def brute(fps):
    """Smallest key reachable, by all pairs of (key, fp)."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(fps):
        r = root(i)
        if k is not None:
            least[r] = k if least[r] is None else min(least[r], k)
    return [least[root(i)] for i in range(len(fps))]


def test_masks_cover_the_radius():
    rng = random.Random(5)
    for level in range(4):
        held = [m % (1 << 64) for m in simhash.masks(level)]
        assert len(set(held)) == 31
        for _ in range(4000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            assert any(not diff & m for m in held)


def test_fingerprint_against_plain_code():
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "a b c", "a b c d", "A B c d e", "é É ß" * 3, "same same same same same same " * 30]
    texts += [" ".join(rng.choices(["the", "of", "x", "Y", "über"], k=rng.randrange(200))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == plain(t)


def near(rng, n=400):
    fps = []
    for _ in range(n):
        base = rng.choice(fps) if fps and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            base ^= 1 << b
        fps.append(base)
    return fps


@pytest.mark.parametrize(("least_hot", "most_hot", "batch"), [(3, 4_000_000, 7), (3, 2, 10_000), (4096, 4_000_000, 1)])
def test_components_of_links_against_all_pairs(spark, monkeypatch, least_hot, most_hot, batch):
    """Hot buckets dealt again, too many of them to tell apart, buckets that go over several batches."""
    monkeypatch.setattr(simhash, "MOST_HOT", most_hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        components_against_all_pairs(spark, least_hot)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def components_against_all_pairs(spark, least_hot):
    rng = random.Random(least_hot)
    fps = list(dict.fromkeys(near(rng)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, least_hot=least_hot)).collect()}
    want = brute(list(enumerate(fps)))
    groups = defaultdict(set)
    for s, w in zip(signed, want, strict=True):
        groups[w].add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_large_bucket_in_one_task():
    import numpy as np

    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(0xABCDEF) ^ np.concatenate([rng.integers(0, 1 << 14, 18000, dtype=np.uint64) << np.uint64(40), rng.integers(0, 1 << 14, 18000, dtype=np.uint64)]))
    assert len(fps) > 20_000
    a, b = [], []
    simhash._forest(fps, 4, 1, a, b)
    assert len(a) <= len(fps) and all((x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    x, y = [], []
    old = fps[::9]
    simhash._forest(old, 4, 4, x, y)
    assert len(x) == len(old) - 1  # one component
    assert len(a) == len(fps) - 1


def test_documents_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate([None, "", " ", rows[3][1], rows[3][1] + " x"])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    fps = [(k, plain(t)) for k, t in rows]
    want = {k: (f, c) for (k, f), c in zip(fps, brute(fps), strict=True)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()}
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_null_and_repeated_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "p q r s t"), (None, "p q r s t"), (None, "other words here now"), (4, "other words here now"), (9, "lone text of nine"), (9, "lone text of nine")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == [(0, "p q r s t"), (4, "other words here now"), (9, "lone text of nine")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.classes(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "a b c d e " * 100_000
    got = simhash.classes(spark.createDataFrame([(1, text), (2, text + "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
