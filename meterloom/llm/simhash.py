"""Near-duplicate classes by SimHash and covering locality-sensitive hashing (operator 5).

Fingerprints. A-Z are lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``; every 4-word shingle,
repeats included, votes with its XXH64 (seed 42). A text of fewer words votes as a whole; a null,
empty or blank text has fingerprint 0 and links like any other.

Links. Bit i of a fingerprint is given a random vector m(i) of r+1 bits. Table v (each non-zero
vector of r+1 bits) compares the bits with <m(i), v> = 1. Two fingerprints that differ in at most r
bits span at most r dimensions, so some v is orthogonal to all their differing bits and both fall
into one bucket of table v: no link is missed. Only distinct fingerprints are dealt to the tables,
so exact copies, however many, are one row.

A bucket emits a spanning forest of its links, never its pairs. Buckets with more than 1/10,000 of
all rows (and over ``least_hot``), and any with more than MOST_ROWS, are dealt again by masks of the next level. There are
at most max(10,000, rows / MOST_ROWS) of these, so their list, 8 bytes each, is broadcast; where it could pass MOST_HOT, all
rows are dealt again instead. Inside a task a large bucket is split the same way.

Components. Rounds of "point to the smallest neighbour, follow pointers, contract" halve the nodes at
least; links stay distributed, and every round is written to the shared folder.

Very long texts are read whole. Ties: a bit that just half of the votes set is 0. Repeated rows have one fingerprint and class each;
null keys get a class, but are no class's name. Empty tables give no rows. Extra columns are dropped by ``classes``, whatever
their names, and pass through ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import common

RADIUS = 4
SHINGLE = 4
#: Buckets with more rows than 1/HOT_BUCKETS of the total are dealt again.
HOT_BUCKETS = 10_000
#: A bucket with more rows than this is always dealt again: a task holds it as 8 bytes a row.
MOST_ROWS = 1_000_000
#: The longest list of hot buckets that is broadcast.
MOST_HOT = 4_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        votes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = [0, *ends[: -shingle].tolist()]
        votes = [digest(line[a:b], 42) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    n, counts = len(votes), np.zeros(64, np.int64)
    hashes = np.array(votes, "<u8").view(np.uint8).reshape(-1, 8)
    for begin in range(0, n, 65536):
        counts += np.unpackbits(hashes[begin : begin + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def masks(level: int, radius: int = RADIUS, seed: int = 20240) -> list[int]:
    """The 2**(radius+1) - 1 masks of a level, as signed longs."""
    import random

    rng = random.Random(seed + level)
    dims = radius + 1
    bits = list(range(64))
    rng.shuffle(bits)
    vectors = [0] * 64
    for place, bit in enumerate(bits):  # the non-zero vectors in turn: about half of the bits in every mask
        vectors[bit] = place % ((1 << dims) - 1) + 1
    out = []
    for v in range(1, 1 << dims):
        mask = sum(1 << bit for bit in range(64) if (vectors[bit] & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _forest(fps, radius: int, level: int, out_a: list, out_b: list) -> None:
    """Adds the edges of a spanning forest of the links among distinct fps (uint64 array)."""
    import numpy as np

    if len(fps) > 20_000 and level < 4:
        roots = {}

        def root(x):
            while (up := roots.get(x, x)) != x:
                roots[x] = x = roots.get(up, up)
            return x

        for mask in masks(level, radius):
            held = fps & np.uint64(mask % (1 << 64))
            order = np.argsort(held, kind="stable")
            cuts = np.flatnonzero(np.diff(held[order])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
                if end - begin > 1:
                    a, b = [], []
                    _forest(fps[order[begin:end]], radius, level + 1, a, b)
                    for x, y in zip(a, b, strict=True):
                        if (p := root(x)) != (q := root(y)):
                            roots[max(p, q)] = min(p, q)
                            out_a.append(x)
                            out_b.append(y)
        return
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out_a.extend([int(at)] * len(found))
                out_b.extend(found.tolist())
                queue.extend(found)


def _bucket_edges(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """(bucket, fp) -> (a, b): links within each bucket, as a spanning forest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(buckets, fps):
            a, b = [], []
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(buckets)]])
            size = ends - begins
            for begin in begins[size == 2].tolist() if len(buckets) else []:
                pairs.append(begin)
            if pairs:
                i = np.array(pairs)
                near = np.bitwise_count(fps[i] ^ fps[i + 1]) <= radius
                a.extend(fps[i][near].tolist())
                b.extend(fps[i + 1][near].tolist())
                pairs.clear()
            for begin, end in zip(begins[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                _forest(fps[begin:end], radius, level + 1, a, b)
            x, y = (np.array(v, np.uint64).view(np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        pairs: list[int] = []
        held: list[tuple] = []  # parts of the bucket that may go on in the next batch, joined once it is whole
        for batch in batches:
            b, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(b):
                continue
            last = int(np.searchsorted(b, b[-1]))  # b is sorted
            if held and (last or b[0] != held[0][0][0]):
                held.append((b[:last], f[:last]))
                yield edges(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            elif last:
                yield edges(b[:last], f[:last])
            held.append((b[last:], f[last:]))
        if held:
            yield edges(*map(np.concatenate, zip(*held, strict=True)))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, least_hot: int = 4096) -> DataFrame:
    """Links (a < b) among the distinct fingerprints of column fp, enough to connect every two within the radius."""
    found = None
    rows = fps.select(F.lit(0).cast("long").alias("bucket"), "fp")
    for level in range(4):
        tables = [F.xxhash64(F.lit(t), F.col("bucket"), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(level, radius))]
        rows = rows.select(F.explode(F.array(*tables)).alias("bucket"), "fp")
        hot = None
        if level < 3:
            counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            total = fps.count() * len(tables) if level == 0 else rows.count()
            most = max(least_hot, min(total // HOT_BUCKETS, MOST_ROWS))
            if total > most:
                hot = common.stash(counts.where(F.col("n") > most).select("bucket"), "hot-buckets")
                n = hot.count()
                if n > MOST_HOT:  # too many to tell apart: all rows go on
                    continue
                hot = hot if n else None
        if hot is None:
            part = _bucket_edges(rows, radius, level)
            return (found.unionByName(part) if found is not None else part).distinct()
        hot_df = F.broadcast(hot)
        part = _bucket_edges(rows.join(hot_df, "bucket", "left_anti"), radius, level)
        found = found.unionByName(part) if found is not None else part
        rows = rows.join(hot_df, "bucket", "left_semi")
    raise AssertionError("the last level has no hot buckets")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b); root is a node of the component."""
    edges = common.stash(edges, "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    held = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p")), "pointers")
        while True:  # every pointer leads to a smaller node, so following them ends at a root
            step = common.join_unique(up.select("x", F.col("p").alias("q")), up.select(F.col("x").alias("q"), F.col("p").alias("p2")), "q").select("x", F.coalesce("p2", "q").alias("p"), (F.coalesce("p2", "q") != F.col("q")).alias("moved"))
            step = common.stash(step, "pointers")
            up = step.select("x", "p")
            if step.where("moved").isEmpty():
                break
        at = lambda side, left: common.join_unique(left.withColumnRenamed(side, "x"), up, "x").withColumn(side, F.coalesce("p", "x")).drop("x", "p")
        held = common.stash(at("root", held), "roots")
        edges = common.stash(at("b", at("a", edges)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return held


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, least_hot: int = 4096) -> DataFrame:
    """One row per row of docs: key, fp, component_id (the smallest key reachable over links; null keys don't count)."""
    rows = common.stash(fingerprints(docs, key, text), "fingerprints")
    fps = common.stash(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    found = components(links(fps, radius, least_hot))
    named = found.select(F.col("node").alias("fp"), "root")
    least = fps.join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = fps.join(common.join_unique(named, least, "root", least=500).select("fp", "component_id"), "fp", "left")
    by_fp = common.stash(by_fp.select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return common.join_unique(rows, by_fp, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, the one with the smallest key; all columns stay.

    Rows that share a key count as one document: the one with the smallest text stays. Rows with a
    null key stay, one per fingerprint, where no row with a key has that fingerprint.
    """
    from pyspark.sql import Window

    rows = common.stash(classes(docs, key, text), "near-copies")
    keepers = rows.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept")).distinct()
    # Merged at every size: the keepers grow with the documents, so they are never broadcast.
    kept = docs.join(keepers.hint("merge"), F.col(key) == F.col("__kept"), "left_semi")
    if not rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(text))).where("__place = 1").drop("__place")
    if rows.where(F.col(key).isNull()).isEmpty():
        return kept
    held = rows.where(F.col(key).isNotNull()).select("fp").distinct()
    bare = docs.where(F.col(key).isNull())
    own = fingerprints(bare.select(F.col(text).alias("__t"), F.struct(*bare.columns).alias("__row")), "__row", "__t")
    own = own.join(held, "fp", "left_anti").groupBy("fp").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return kept.unionByName(own.select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprints and components of all documents."""
    rows = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
