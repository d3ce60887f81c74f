"""Sharding by a k-d tree over metadata (operator 4), under the law `bytes`: sizes near equal.

Every document is a point: size, share of blanks and share of non-ASCII bytes, all taken from the
text, so equal texts are one point; a hash of the text orders points that agree. A node
that is to become k leaves is split along its widest dimension (in units of the whole table's range)
at the weighted median, or the k//2 : k - k//2 quantile, until each leaf is one shard. Leaves reach
target_bytes where that is given instead of a count.

The median is found by histograms: each round counts the bytes of BINS bins per open node and narrows
to one bin, then to the text hash where values agree, until a bin holds no more than 1/FINE of a
shard's bytes; the driver sees at most nodes x BINS sums.
Assignment is an expression over a point's own columns, so it needs no join.

Groups of equal texts stay in one shard unless they hold more than 1/PIECES of a shard's bytes; such
a group (there are at most PIECES x shards of them) is dealt into pieces by doc_id. So hot groups split
and sizes stay within a few hundredths of each other.

Size is the UTF-8 length plus 8; a null text has length 0 and crc32 0. Null and repeated doc_ids and
repeated rows are points like any other; rows that tie in all of key and text may get each other's slot. A very long text may be
larger than a shard, which then holds it alone. An empty table gives no rows. Extra columns are dropped by ``shard``;
``write_shards`` keeps them, and a column named ``shard`` or ``slot`` as ``doc_shard`` or ``doc_slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm import common

SHARDS = 24
BINS = 4096
FINE = 1000
PIECES = 50
LEAST = -(1 << 62)
DIMENSIONS = ("x0", "x1", "x2")
#: Rows of one task when slots are numbered.
SLOT_ROWS = 100_000


def points(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """key, size, text_crc32, the text's hash and its coordinates (integers); with `whole` also the row itself."""
    t = F.col("__text")
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), *own)
    n = F.octet_length(t).cast("long")
    per = lambda c: F.coalesce(F.floor(F.try_divide(c * 10_000, n)), F.lit(0)).cast("long")
    return rows.select(
        "key", *(["row"] if whole else []), (n + 8).alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t, F.lit("shard")).alias("h"),
        F.floor(F.log2(n + 8) * 1000).cast("long").alias("x0"), per(blanks).alias("x1"), per(n - F.length(t)).alias("x2"),
    )


def with_order(rows: DataFrame, shards: int) -> DataFrame:
    """rows with `o`, which orders points that agree: the text hash, or for oversized groups that of a piece (62 bits)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // (shards * PIECES))
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    found = common.bounded(groups, shards * PIECES, "oversized groups")
    if not found:
        return rows.withColumn("o", F.shiftright("h", 2))
    pieces = F.broadcast(common.small_table(rows.sparkSession, [(r.h, int(2 * r.bytes // most) + 1) for r in found], "h bigint, pieces bigint"))
    piece = F.pmod(F.xxhash64("key", F.lit("piece")), F.col("pieces"))
    return rows.join(pieces, "h", "left").withColumn("o", F.shiftright(F.when(F.col("pieces").isNull(), F.col("h")).otherwise(F.xxhash64("h", piece)), 2)).drop("pieces")


class Node:
    """A box of the tree: a leaf (shard) or a split of column `by` and then `o` below a cut."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.by = self.cut = self.cut_o = self.low = self.high = None

    def column(self, value, depth: int = 0) -> Column:
        """value(leaf) of the leaf that holds a row."""
        if self.low is None:
            return F.lit(value(self))
        below = (F.col(self.by) < self.cut) | ((F.col(self.by) == self.cut) & (F.col("o") < F.lit(self.cut_o)))
        return F.when(below, self.low.column(value, depth + 1)).otherwise(self.high.column(value, depth + 1))

    def leaves(self) -> list[Node]:
        return [self] if self.low is None else self.low.leaves() + self.high.leaves()


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree over rows (size, x0.., o)."""
    root = Node(0, shards)
    whole = rows.agg(F.sum("size").alias("w"), *[f(c).alias(f"{n}{c}") for c in DIMENSIONS for n, f in (("a", F.min), ("b", F.max))]).first()
    fine = (whole.w or 0) // (shards * FINE)
    scale = {c: max(1, (whole[f"b{c}"] or 0) - (whole[f"a{c}"] or 0)) for c in DIMENSIONS}
    while open_ := [x for x in root.leaves() if x.shards > 1]:
        at = rows.withColumn("n", root.column(lambda x: x.first if x.shards > 1 else -1)).where("n >= 0")
        stats = {r.n: r for r in at.groupBy("n").agg(F.sum("size").alias("w"), *[f(c).alias(f"{n}{c}") for c in DIMENSIONS for n, f in (("a", F.min), ("b", F.max))], F.min("o").alias("ao"), F.max("o").alias("bo")).collect()}
        search = {}
        for x in open_:
            x.by, r = DIMENSIONS[0], stats.get(x.first)
            if r:
                x.by = max(DIMENSIONS, key=lambda c: ((r[f"b{c}"] - r[f"a{c}"]) / scale[c], -DIMENSIONS.index(c)))
            lo, hi = (r[f"a{x.by}"], r[f"b{x.by}"]) if r else (0, 0)
            # Bytes wanted below the cut; the open interval of values, then of the order at one value.
            search[x.first] = {"node": x, "want": r.w * (x.shards // 2) / x.shards if r else 0, "lo": lo, "hi": hi, "ao": r.ao if r else 0, "bo": r.bo if r else 0, "below": 0, "stage": "value" if r else "done"}
            x.cut, x.cut_o = lo, LEAST
        _narrow(at, search, fine)
        for x in open_:
            k = x.shards // 2
            x.low, x.high = Node(x.first, k), Node(x.first + k, x.shards - k)
    return root


def _narrow(at: DataFrame, search: dict, fine: int) -> None:
    """Rounds of histograms until every node has its cut."""
    while todo := {k: s for k, s in search.items() if s["stage"] != "done"}:
        for s in todo.values():
            if s["stage"] == "value" and s["lo"] == s["hi"]:
                s["stage"], s["value"], s["lo"], s["hi"] = "order", s["lo"], s["ao"], s["bo"]
        for s in todo.values():
            s["step"] = -(-(s["hi"] - s["lo"] + 1) // BINS)
        # One row per open node: at most `shards` rows.
        nodes = [(k, DIMENSIONS.index(s["node"].by), s.get("value"), s["lo"], s["hi"], s["step"]) for k, s in todo.items()]
        nodes = F.broadcast(common.small_table(at.sparkSession, nodes, "n int, d int, value bigint, lo bigint, hi bigint, step bigint"))
        by = F.element_at(F.array(*DIMENSIONS), F.col("d") + 1)
        seen = at.join(nodes, "n").withColumn("v", F.when(F.col("value").isNull(), by).when(by == F.col("value"), F.col("o")))
        bins = seen.where("v BETWEEN lo AND hi").select("n", "size", F.expr("int((v - lo) div step)").alias("bin"))
        sums: dict[int, dict[int, int]] = {}
        for r in bins.groupBy("n", "bin").agg(F.sum("size").alias("w")).collect():
            sums.setdefault(r.n, {})[r.bin] = r.w
        for k, s in todo.items():
            lo, step, node = s["lo"], s["step"], s["node"]
            chosen = None
            for b, w in sorted(sums.get(k, {}).items()):
                if s["below"] + w > s["want"]:
                    chosen = (b, w)
                    break
                s["below"] += w
            if chosen is None:  # all that was open lies below the cut
                node.cut, node.cut_o = (s["hi"] + 1, LEAST) if s["stage"] == "value" else (s["value"], s["hi"] + 1)
                s["stage"] = "done"
                continue
            s["lo"], s["hi"] = lo + chosen[0] * step, min(s["hi"], lo + (chosen[0] + 1) * step - 1)
            if chosen[1] <= fine or s["stage"] == "order" and step == 1:  # little, or one group: on the side that it fits better
                cut = s["hi"] + 1 if s["below"] + chosen[1] - s["want"] < s["want"] - s["below"] else s["lo"]
                node.cut, node.cut_o = (cut, LEAST) if s["stage"] == "value" else (s["value"], cut)
                s["stage"] = "done"


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    return _sharded(docs, shards, target_bytes, key, text).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def _sharded(docs: DataFrame, shards: int | None, target_bytes: int | None, key: str, text: str, whole: bool = False) -> DataFrame:
    rows = common.stash(points(docs, key, text, whole), "points")
    if shards is None:
        shards = max(1, round((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    ordered = with_order(rows, shards)
    tree = grow(ordered, shards)
    return _slots(ordered.withColumn("shard", tree.column(lambda x: x.first).cast("int")), shards)


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard: parts of about SLOT_ROWS rows are numbered apart and put in a row."""
    parts = max(1, rows.count() // (shards * SLOT_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("o", "key", F.lit("slot")), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("begun"))
    # Copies of one row can't be told apart, so any order among them is the same result.
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "h")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "part"]).withColumn("slot", (F.col("begun") + F.col("place")).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int | None = SHARDS, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs with shard and slot under `path`, one folder a shard; the rows travel with their points, so nothing is joined by key."""
    rows = _sharded(docs, shards, target_bytes, key, text, whole=True)
    named: list[str] = []
    for c in docs.columns:
        name = c
        while name.lower() in ("shard", "slot") or name != c and name in docs.columns:
            name = f"doc_{name}"
        named.append(name)
    out = rows.select("shard", "slot", *[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, named, strict=True)])
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the shards of all documents."""
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
