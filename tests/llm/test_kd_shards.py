import random
import zlib
from collections import defaultdict

import pytest

from meterloom.llm import kd_shards


def check(spark, rows, shards):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    got = kd_shards.shard(docs, shards=shards).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((k is None, k or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, sizes


def test_sizes_are_near_equal_and_groups_stay(spark, sf_dir):
    real = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    rows = [(i, rng.choice(real)[1][: rng.randrange(20, 900)] + str(i), "x") for i in range(3000)]
    rows += [(5000 + i, rows[i % 40][1], "x") for i in range(200)]
    got, sizes = check(spark, rows, 24)
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) < 1.08 * mean and min(sizes.values()) > 0.92 * mean
    text = {k: t for k, t, _ in rows}
    homes = defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    most = sum(sizes.values()) // (24 * kd_shards.PIECES)
    size = defaultdict(int)
    for _, t, _ in rows:
        size[t] += len(t.encode()) + 8
    small = [t for t in homes if size[t] <= most]
    assert len(small) > 1000 and all(len(homes[t]) == 1 for t in small)
    assert sum(len(s) > 1 for s in homes.values()) <= 23  # a cut splits one group at most


def test_a_group_of_a_third_is_split(spark):
    rows = [(i, f"text number {i} " * (i % 9 + 1), "x") for i in range(4000)] + [(9000 + i, "one and the same " * 5, "x") for i in range(2000)]
    _, sizes = check(spark, rows, 24)
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "x"), (None, "", "x"), (2, "b", "x")], [(i, "same", "x") for i in range(50)]])
def test_small_and_odd_tables(spark, rows):
    check(spark, rows, 24)
    check(spark, rows, 1)


def test_target_bytes(spark):
    docs = spark.createDataFrame([(i, "abcd" * 23) for i in range(100)], "doc_id long, text string")
    assert kd_shards.shard(docs, shards=None, target_bytes=2000).agg({"shard": "max"}).first()[0] == 4


def plain_tree(points, shards, first=0, scale=None):
    """shard of every point (x0, x1, x2, o, size): exact weighted medians, by sorting."""
    dims = range(3)
    width = [max((p[d] for p in points), default=0) - min((p[d] for p in points), default=0) for d in dims]
    scale = scale or [max(1, w) for w in width]
    if shards == 1 or not points:
        return [first] * len(points)
    by = max(dims, key=lambda d: (width[d] / scale[d], -d))
    want = sum(p[4] for p in points) * (shards // 2) / shards
    weights = defaultdict(int)
    for p in points:
        weights[p[by], p[3]] += p[4]
    below, low = 0, set()
    for group in sorted(weights):
        w = weights[group]
        if below + w > want:
            if below + w - want < want - below:
                low.add(group)
            break
        below += w
        low.add(group)
    out, half = [None] * len(points), shards // 2
    for inside, k, start in ((True, half, first), (False, shards - half, first + half)):
        at = [i for i, p in enumerate(points) if ((p[by], p[3]) in low) == inside]
        for i, s in zip(at, plain_tree([points[i] for i in at], k, start, scale), strict=True):
            out[i] = s
    return out


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_shards_against_a_plain_tree(spark, shards):
    rng = random.Random(shards)
    parts = ["a", "bb ", "é", "日本 ", "word ", "  "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = kd_shards.with_order(kd_shards.points(docs), shards).collect()
    want = dict(zip([r.key for r in ordered], plain_tree([(r.x0, r.x1, r.x2, r.o, r.size) for r in ordered], shards), strict=True))
    assert {r.doc_id: r.shard for r in kd_shards.shard(docs, shards=shards).collect()} == want


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(1, "aa", "x", 5), (1, "bb", "y", 6), (None, "cc", "z", 7), (None, "cc", "z", 7), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, Slot int")
    got = kd_shards.write_shards(docs, f"file://{tmp_path}/w", shards=3)
    assert sorted(map(str, got.select("doc_id", "text", "doc_shard", "doc_Slot").collect())) == sorted(str(r).replace("shard=", "doc_shard=").replace("Slot=", "doc_Slot=") for r in docs.collect())
    own = defaultdict(list)
    for r in got.collect():
        own[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in own.values())
    assert kd_shards.write_shards(docs.limit(0), f"file://{tmp_path}/e").count() == 0


def test_a_very_long_text(spark):
    _, sizes = check(spark, [(i, f"short text {i}", "x") for i in range(500)] + [(900, "long words " * 60_000, "x")], 4)
    assert sorted(sizes.values())[-1] >= 660_000
