import random
from collections import Counter

from meterloom.llm import decontam as d


def brute(items, text):
    """Best similarity of every item over all windows of its size."""
    words = d.words_of(text)
    out = {}
    for k, t in items:
        own = d.words_of(t)
        if not own or len(own) > len(words):
            continue
        weights = Counter(d.shingles_of(own))
        best = max(d.weighted_similarity(Counter(d.shingles_of(words[i : i + len(own)])), weights) for i in range(len(words) - len(own) + 1))
        if best >= 0.8:
            out[k] = best
    return out


def make(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 40, 60])))) for i in range(60)]
    items += [(100, "a b a b a b a b a b a b"), (101, None), (102, ""), (103, items[20][1])]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=rng.randrange(0, 300))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return items, [*docs, (500, None), (501, ""), (502, "a b " * 30), (503, "x"), (504, "x y"), (505, "x y z")]


def test_matches_against_all_windows(spark):
    items, rows = make()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, similarity double").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in d.matches(docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.similarity
        words = d.words_of(dict(rows)[r.doc_id])[r.first_word : r.end_word]
        assert abs(d.weighted_similarity(Counter(d.shingles_of(words)), Counter(d.shingles_of(d.words_of(dict(items)[r.item_id])))) - r.similarity) < 1e-9
    want = {k: w for k, t in rows if (w := brute(items, t))}
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    assert all(abs(got[k][i] - s) < 1e-9 for k, w in want.items() for i, s in w.items())
    kept = d.remove(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - set(want)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    items, rows = make(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()}
    monkeypatch.setattr(d, "MOST_ITEMS", 25)
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()} == whole
    assert d.matches(docs, bench.limit(0)).count() == 0
    assert d.matches(docs.limit(0), bench).count() == 0
    assert d.remove(docs, bench.limit(0)).count() == len(rows)


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(3)
    fps = [rng.getrandbits(128) for _ in range(300)]
    split = lambda x: [x & (1 << 64) - 1, x >> 64]
    for radius in (0, 7, 8, 15, 22, 31, 39):
        index = d.MultiIndex([split(f) for f in fps], radius)
        queries = []
        for _ in range(60):
            q = rng.choice(fps)
            for b in rng.sample(range(128), rng.randrange(60)):
                q ^= 1 << b
            queries.append(q)
        row, item = index.near_many([split(q) for q in queries])
        assert list(zip(row.tolist(), item.tolist(), strict=True)) == [(i, j) for i, q in enumerate(queries) for j, f in enumerate(fps) if (f ^ q).bit_count() <= radius]


def test_the_index_prunes_and_finds_similar_windows():
    """Few candidates a window, and of windows of similarity 0.8 or more at least 99 % come through the index."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(500)]
    items = d.Items(list(enumerate(texts)))
    index = items.by_size[40][1]
    fp = lambda words: [d.fingerprint(d.shingles_of(words))]
    found = wanted = 0
    for i, t in enumerate(texts):
        words = d.words_of(t)
        shift = rng.choice([0, 1, 2, 3, 4])  # a window that lies some words off
        words = words[shift:] + d.words_of(" ".join(rng.choices(vocabulary, k=shift)))
        if d.weighted_similarity(Counter(d.shingles_of(words)), items.weights(i)) >= 0.8:
            wanted += 1
            found += i in index.near_many(fp(words))[1]
    assert wanted > 300 and found >= 0.99 * wanted
    strange = [fp(d.words_of(" ".join(rng.choices(vocabulary, k=40))))[0] for _ in range(300)]
    assert len(index.near_many(strange)[0]) == 0  # of 150,000 pairs


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_ITEM_BYTES", 200_000)
    rng = random.Random(7)
    items = [(f"item-{i}", " ".join(rng.choices([f"w{j}" for j in range(999)], k=1600))) for i in range(60)] + [(None, "x " * 150_000)] + [("again", "y z " * 30)] * 50
    blocks = list(d.item_blocks(spark.createDataFrame(items, "item_id string, text string")))
    assert sorted((str(k), t) for b in blocks for k, t in b) == sorted({(str(k), t) for k, t in items})
    assert all(sum(len(t) for _, t in b) <= 200_000 or len(b) == 1 for b in blocks) and len(blocks) > 2
    docs = spark.createDataFrame([(1, "a b " + items[5][1].upper()), (2, "nothing"), (3, "x " * 150_001)], "doc_id long, text string")
    got = d.matches(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, "item-5"), (3, None)}


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("d1", "q w e r t y u i o p"), (None, "q w e r t y u i o p")], "doc_id string, text string")
    for kind, value in (("string", "k"), ("int", 3), ("date", __import__("datetime").date(2024, 1, 2)), ("struct<a:long>", (5,))):
        bench = spark.createDataFrame([(value, "q w e r t y u i o p")], f"item_id {kind}, text string")
        got = d.matches(docs, bench)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert sorted((str(r.doc_id), r.similarity) for r in got.collect()) == [("None", 1.0), ("d1", 1.0)]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, k) for r in docs.collect() for k in brute(items, r.text)}
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()} == want and want
