"""Benchmark decontamination by SimHash of item-sized windows (operator 7).

Words: A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``. An item is the multiset of its 5-word shingles
(fewer words: the whole sequence). For every item length, windows of that many words slide over each
document; a document of fewer words is one window as a whole. A window's SimHash has BITS bits (two XXH64 of
every shingle vote; the second, third and later occurrence of a shingle in a window vote by hashes of their own, so that
the weights of a multiset count like members of a set). It is looked up in a multi-index of the items' fingerprints: the bits are cut into blocks,
and two fingerprints within the radius agree in some block up to radius // blocks bits. Those flips
are shared out: the index lists every item under all block values within one flip, the window
probes all values within the others, so all items within the radius are found, and no others.
Candidates are verified by exact weighted Jaccard similarity of the shingle multisets.

Radius: at the least similarity, 0.8, a ninth of both multisets differs, an angle at which 15 % of the bits
do: 19.4 of 128 with a deviation of 4.1, so the radius of 31 loses about one in 400 of the windows that
are just similar enough, and none that are equal; two random fingerprints come within it once in 10**8.

Windows are only formed where they can pass: at similarity s, a window must hold at least s times as
many known shingles (those of any item of its length) as the item has, so windows with fewer are skipped without loss.

The items are the stated query set, repeated ones taken once. They are read in blocks of at most MOST_ITEMS rows and
MOST_ITEM_BYTES (a longer item is a block of its own), each small enough to send with the tasks, and every
block goes over all documents in one scan each.

Null and empty documents and items match nothing. Very long texts are searched whole. Ties: of equally similar windows of an
item the first is reported. Repeated documents give repeated results. Keys of documents and items may be
of any type and null; extra columns, whatever their names, are dropped by ``matches`` and pass through ``remove``
unchanged. An empty table of either kind gives no matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import common

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
RADIUS = 31
BLOCKS = 8
MOST_ITEMS = 50_000
MOST_ITEM_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], width: int = SHINGLE) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def weighted_similarity(a: dict, b: dict) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if low else 0.0


def digests(shingles, times=None):
    """(n, BITS // 64) hashes of shingles; times: how often each has occurred before (0 if not given)."""
    import numpy as np
    import xxhash

    one, words = xxhash.xxh64_intdigest, BITS // 64
    seeds = [42 + words * n for n in times] if times is not None else [42] * len(shingles)
    return np.array([one(s, seed + k) for s, seed in zip(shingles, seeds, strict=True) for k in range(words)], np.uint64).reshape(len(shingles), words)


def fingerprint(shingles):
    """The fingerprint (BITS // 64 words) of a multiset of shingles."""
    seen: dict[bytes, int] = {}
    times = []
    for s in shingles:
        seen[s] = n = seen.get(s, -1) + 1
        times.append(n)
    return pack_bits(simhash_bits(digests(shingles, times)).sum(axis=0, keepdims=True))[0]


def simhash_bits(hashes):
    """(n, BITS) matrix of +1 and -1."""
    import numpy as np

    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack_bits(sums):
    """Fingerprints (n, BITS // 64) of rows of sums: a bit is 1 where its sum is positive."""
    import numpy as np

    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


class MultiIndex:
    """Fingerprints (n, BITS // 64) by 16-bit blocks; `near_many` finds all within the radius, and no others."""

    def __init__(self, fps, radius: int = RADIUS, blocks: int = BLOCKS):
        import itertools

        import numpy as np

        self.fps, self.radius = np.asarray(fps, np.uint64).reshape(len(fps), -1), radius
        values = self._values(self.fps, blocks)
        width = 16 * values.dtype.itemsize // 2
        reach = radius // blocks  # some block differs in no more bits than this
        flips = lambda most: np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in itertools.combinations(range(width), n)], values.dtype)
        held, self.probes = flips(min(reach, 1)), flips(max(0, reach - 1))
        self.keys, self.items = [], []
        for j in range(blocks):
            own = (values[:, j, None] ^ held).ravel()
            order = np.argsort(own, kind="stable")
            self.keys.append(own[order])
            self.items.append((order // len(held)).astype(np.int32))

    @staticmethod
    def _values(fps, blocks: int):
        import numpy as np

        return np.ascontiguousarray(fps, "<u8").view("<u2").reshape(len(fps), blocks)

    def near_many(self, prints):
        """(place in prints, place in fps) of all pairs within the radius, in order."""
        import numpy as np

        prints = np.asarray(prints, np.uint64).reshape(len(prints), -1)
        values, pairs = self._values(prints, len(self.keys)), [np.empty(0, np.int64)]
        for j, (keys, items) in enumerate(zip(self.keys, self.items, strict=True)):
            wanted = (values[:, j, None] ^ self.probes).ravel()
            begin = np.searchsorted(keys, wanted)
            n = np.searchsorted(keys, wanted, side="right") - begin
            some = np.flatnonzero(n)
            begin, n = begin[some], n[some]
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.repeat(some // len(self.probes), n) * len(self.fps) + items[at])
        both = np.unique(np.concatenate(pairs))
        row, item = np.divmod(both, max(1, len(self.fps)))
        close = np.bitwise_count(prints[row] ^ self.fps[item]).sum(axis=1) <= self.radius
        return row[close], item[close]


class Items:
    """The items of one block, ready to be looked for."""

    MOST_WEIGHTS = 20_000  # items whose shingles are kept counted

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS, width: int = SHINGLE):
        import numpy as np

        self.similarity, self.width = similarity, width
        self.ids, self.texts, self.sizes, fps, seen = [], [], [], [], {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles = shingles_of(words, width)
            self.ids.append(item_id)
            self.texts.append(b" ".join(words))
            self.sizes.append(len(words))
            fps.append(fingerprint(shingles))
            own = min(width, len(words))
            codes = self._mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), own)
            seen.setdefault(own, []).append((codes, np.full(len(codes), len(words), np.int64)))
        self.by_size = {}
        for size in sorted(set(self.sizes)):
            at = [i for i, n in enumerate(self.sizes) if n == size]
            self.by_size[size] = (at, MultiIndex([fps[i] for i in at], radius))
        # Known shingles by word hashes of this process; a chance hit only makes a window more.
        self.known = {w: self._known(*map(np.concatenate, zip(*codes, strict=True))) for w, codes in sorted(seen.items())}
        self._weights: dict[int, dict] = {}
        self.windows = self.candidates = 0

    def weights(self, i: int) -> dict:
        """The shingles of an item with their counts."""
        from collections import Counter

        if i not in self._weights:
            if len(self._weights) >= self.MOST_WEIGHTS:
                self._weights.clear()
            self._weights[i] = Counter(shingles_of(self.texts[i].split(b" "), self.width))
        return self._weights[i]

    @staticmethod
    def _repeats(words, a: int, b: int, width: int):
        """For the shingles a to b: the latest place at or before which one of them or of those before stood already."""
        import numpy as np

        last: dict[tuple, int] = {}
        before = np.full(b - a, -1, np.int64)
        for i in range(a, b):
            own = tuple(words[i : i + width])
            before[i - a] = last.get(own, -1)
            last[own] = i
        return np.maximum.accumulate(before)

    @staticmethod
    def _mix(codes, width: int):
        import numpy as np

        n = max(len(codes) - width + 1, 0)
        keys = np.zeros(n, np.uint64)
        for i in range(width):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
            keys ^= keys >> np.uint64(29)
        return keys

    @staticmethod
    def _known(codes, sizes):
        """Distinct codes, a quick table of them, and the lengths of the items of each: where its list begins, and the lists."""
        import numpy as np

        pairs = np.unique(np.stack([codes, sizes.astype(np.uint64)], axis=1), axis=0)
        keys, first = np.unique(pairs[:, 0], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return keys, bits, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)

    def find(self, text: str | None) -> list[tuple]:
        """(item id, first word, word after the last, similarity) of the best window of every item found."""
        import numpy as np

        words = words_of(text)
        if not words or not self.sizes:
            return []
        codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        hits = {}
        for width, (keys, bits, first, sizes) in self.known.items():
            mixed = self._mix(codes, width)
            at = np.flatnonzero(bits[(mixed & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(at):
                place = np.minimum(np.searchsorted(keys, mixed[at]), len(keys) - 1)
                at, place = at[keys[place] == mixed[at]], place[keys[place] == mixed[at]]
                n = first[place + 1] - first[place]
                own = sizes[np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = np.repeat(at, n)
                for size in np.unique(own).tolist():
                    hits[size] = at[own == size]
        return self._verify(words, hits) if hits else []

    def _verify(self, words, hits) -> list[tuple]:
        """The items found, from the places of known shingles by the length of their items."""
        from collections import Counter

        import numpy as np

        best: dict = {}
        made_of: dict[int, dict] = {}
        again: dict[tuple, object] = {}  # fingerprints of windows that repeat a shingle
        for size, places in hits.items():
            width = min(self.width, size)
            made = made_of.setdefault(width, {})

            def bits(a, b, width=width, made=made):
                """Votes of the shingles a to b, hashed on demand."""
                new = [i for i in range(a, b) if i not in made]
                made.update(zip(new, digests([b" ".join(words[i : i + width]) for i in new]), strict=True))
                return simhash_bits(np.array([made[i] for i in range(a, b)], np.uint64))

            at, index = self.by_size[size]
            length = min(size, len(words))  # a document shorter than the items is one window
            n = length - width + 1  # shingles of a window
            starts = np.arange(max(0, int(places[0]) - n + 1), min(len(words) - length, int(places[-1])) + 1)
            held = np.searchsorted(places, starts + n) - np.searchsorted(places, starts)
            starts = starts[held >= self.similarity * (size - width + 1) - 1e-9]
            if not len(starts):
                continue
            cuts = np.flatnonzero(np.diff(starts) > n) + 1
            for run in np.split(starts, cuts):
                votes = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits(int(run[0]), int(run[-1]) + n), axis=0)])
                offsets = run - run[0]
                prints = pack_bits(votes[offsets + n] - votes[offsets])
                for w in np.flatnonzero(self._repeats(words, int(run[0]), int(run[-1]) + n, width)[offsets + n - 1] >= run).tolist():
                    own = tuple(words[int(run[w]) : int(run[w]) + length])
                    if own not in again:
                        again[own] = fingerprint(shingles_of(list(own), self.width))
                    prints[w] = again[own]
                weights = {}
                self.windows += len(run)
                for w, j in zip(*(x.tolist() for x in index.near_many(prints)), strict=True):
                    start, i = int(run[w]), at[j]
                    self.candidates += 1
                    if start not in weights:
                        weights[start] = Counter(shingles_of(words[start : start + length], self.width))
                    similarity = weighted_similarity(weights[start], self.weights(i))
                    if similarity >= self.similarity - 1e-12:
                        own = (-similarity, start, start + length)
                        if i not in best or own < best[i]:
                            best[i] = own
        return [(self.ids[i], a, b, -s) for i, (s, a, b) in sorted(best.items(), key=lambda x: (x[1][1], x[0]))]


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text"):
    """The distinct items in blocks of at most MOST_ITEMS rows and MOST_ITEM_BYTES; a longer item is a block of its own."""
    rows = common.stash(benchmark.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").withColumn("h", F.xxhash64("k", "t")).distinct(), "items")
    rows = rows.withColumn("bytes", F.octet_length("t").cast("long"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    # Halves of halves by the bits of the hash, until a block fits; only the blocks' sums come to the driver.
    todo = [(1, 0, whole.n, whole.bytes or 0)]
    while todo:
        parts, i, n, size = todo.pop()
        own = rows.where(F.pmod("h", F.lit(parts)) == i)
        if n <= MOST_ITEMS and size <= MOST_ITEM_BYTES or n == 1 or parts >= 1 << 40:
            if n:
                yield sorted(((r.k, r.t) for r in own.select("k", "t").collect()), key=lambda r: (r[1], str(r[0])))
            continue
        split = max(2, 1 << max(-(-n // MOST_ITEMS), -(-2 * size // MOST_ITEM_BYTES)).bit_length() - 1)
        sums = own.groupBy(F.pmod("h", F.lit(parts * split)).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
        todo += sorted((parts * split, r.i, r.n, r.bytes) for r in sums)


def _items(block: list[tuple], similarity: float, radius: int) -> Items:
    """The block's items, made ready once by each worker process and kept until another block comes."""
    kept = common.worker_memo("decontam-items", dict)
    own = hash((tuple(block), similarity, radius))
    if kept.get("key") != own:
        kept.clear()
        kept.update(key=own, items=Items([(i, t) for i, (_, t) in enumerate(block)], similarity, radius))
    return kept["items"]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, item: str = "item_id") -> DataFrame:
    """One row per document row and item found: key, item_id, first_word, end_word, similarity."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema[item].dataType)
    schema = T.StructType([docs.schema[key], T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("similarity", T.DoubleType())])
    found = None
    for block in item_blocks(benchmark, item):

        def run(batches, block=block):
            import numpy as np
            import pyarrow as pa

            items = _items(block, similarity, radius)
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in items.find(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(cols[0], np.int64))), pa.array([block[j][0] for j in cols[1]], kind), *[pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), pa.int64(), pa.float64()), strict=True)]], names=schema.names)

        part = docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the documents that hold an item; all columns stay, nothing is shuffled."""
    at = docs.columns.index(text)
    for block in item_blocks(benchmark):

        def run(batches, block=block):
            import pyarrow as pa

            items = _items(block, similarity, radius)
            for batch in batches:
                yield batch.filter(pa.array([not items.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the benchmark items held by documents; documents without one give no row."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
