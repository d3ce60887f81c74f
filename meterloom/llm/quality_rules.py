"""Quality rules as a bitmask ledger (operator 1).

Every rule is evaluated once per document; its failure is one bit of ``fail_bits`` and its
measurement is kept beside it. A policy is a named, versioned set of rules, that is, a bit mask:
applying a policy, comparing policies and leaving one rule out of a policy are bitwise
operations on the ledger and never read the texts again. ``write_ledger`` stores a ledger, ``annotate``
puts it beside the documents' own columns, and ``filter_documents`` applies a policy to that.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null or empty text has no words: all measurements are 0
and it fails ``few_words``. Very long texts are measured whole. Measurements are counts, so ties need no order; a
document fails a rule only beyond its limit. Repeated rows are measured row by row; an empty table gives an empty
ledger, and every rule of an ablation with counts of 0. Extra columns are dropped by ``ledger`` and pass through
``annotate`` and ``filter_documents`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]

#: Rule -> (bit, condition of failure). A condition is written once over measurements by name and serves Spark
#: columns, numbers and SQL text alike. A bit never changes its meaning.
RULES: dict[str, tuple[int, Callable]] = {
    "few_words": (0, lambda m: m["n_words"] < 10),
    "repeated_windows": (1, lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
    "many_symbols": (2, lambda m: m["n_symbols"] * 10 > m["n_words"] * 3),
    "duplicate_lines": (3, lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 10 > m["n_lines"] * 6)),
    "shouting": (4, lambda m: (m["n_letters"] >= 40) & (m["n_upper"] * 10 > m["n_letters"] * 6)),
    "many_marks": (5, lambda m: m["n_marks"] * 10 > m["n_words"] * 5),
    "long_words": (6, lambda m: (m["n_words"] >= 10) & (m["word_chars"] > m["n_words"] * 25)),
    "short_words": (7, lambda m: (m["n_words"] >= 10) & (m["word_chars"] < m["n_words"] * 2)),
}

#: Policy -> its rules. A published policy is never edited; a change gets a new version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "text-1": tuple(RULES),
    "lenient-1": ("few_words", "repeated_windows", "many_symbols"),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy])


def measure_text(text: str | None) -> tuple[int, ...]:
    """All measurements of one text, in the order of MEASURES."""
    import numpy as np

    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D alone
    n = len(words)
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = letters = 0
    codes = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    letters = upper + int(np.count_nonzero((codes >= 97) & (codes <= 122)))
    return (n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters, raw.count(b"!") + raw.count(b"?"))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of `width` words that occur twice or more, the first occurrence included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():  # equal windows have equal keys, so there is none
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    starts = np.flatnonzero(twin)
    ids: dict[tuple, int] = {}
    kinds = [ids.setdefault(tuple(words[i : i + width]), len(ids)) for i in starts.tolist()]  # exact
    often = np.bincount(kinds)[kinds] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i in range(width):
        covered[starts[often] + i] = 1
    return int(covered.sum())


def _measured(texts):
    import numpy as np

    return np.array([measure_text(t) for t in texts], np.int64).reshape(len(texts), len(MEASURES))


def fail_bits(measure=F.col) -> Column:
    """The ledger's bits from the measurements; `measure` gives the column of a measurement."""
    m = {name: measure(name) for name in MEASURES}
    bits = F.lit(0).cast("long")
    for bit, failed in RULES.values():
        bits = bits.bitwiseOR(F.when(failed(m), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def _measure(rows: DataFrame, at: int, kept: list) -> DataFrame:
    """The columns `kept` (a schema's fields, the first ones of rows) and one array of measurements; the text is column `at`."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    schema = StructType([*kept, StructField("__m", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            found = _measured(batch.column(at).to_pylist())
            own = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(MEASURES)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], own], names=schema.names)

    return rows.mapInArrow(run, schema)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, the measurements and fail_bits."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    found = _measure(rows, len(keep), list(rows.schema.fields[:-1]))
    found = found.select(*keep, *[F.col("__m")[i].alias(m) for i, m in enumerate(MEASURES)])
    return found.withColumn("fail_bits", fail_bits())


def write_ledger(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores the ledger as Parquet and returns the table: policies read it, not the texts."""
    rows = ledger(docs, text, keep)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def annotate(docs: DataFrame, text: str = "text", name: str = "__ledger") -> DataFrame:
    """docs with a column of their measurements and fail_bits, in one pass without a shuffle."""
    found = _measure(docs, docs.columns.index(text), list(docs.schema.fields))
    bits = fail_bits(lambda m: F.col("__m")[MEASURES.index(m)])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*[F.col("__m")[i].alias(m) for i, m in enumerate(MEASURES)], bits.alias("fail_bits")).alias(name))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept` under a policy, n_failed of its rules, and only_rule: the one that alone rejects (without it the document is kept)."""
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    only = F.coalesce(*[F.when(own == 1 << RULES[r][0], F.lit(r)) for r in POLICIES[policy]])
    return rows.withColumns({"kept": own == 0, "n_failed": F.bit_count(own).cast("long"), "only_rule": only})


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and those kept without it.

    Documents are first counted by their bits (at most 2**len(RULES) patterns, combined on the map
    side), so the ablation itself reads patterns, not documents.
    """
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = rows.groupBy(own.alias("__bits")).agg(F.count(F.lit(1)).alias("__n"))
    rules = rows.sparkSession.createDataFrame([(r, 1 << RULES[r][0]) for r in POLICIES[policy]], "rule string, __bit long")
    hits = F.col("__bits").bitwiseAND(F.col("__bit")) != 0
    alone = F.col("__bits") == F.col("__bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0)).cast("long")
    return rules.join(patterns, F.lit(True), "left").groupBy("rule").agg(count(hits).alias("n_failed"), count(alone).alias("n_failed_alone"), count((F.col("__bits") == 0) | alone).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: str = "text-1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps by their ledger, with all their columns, in one pass without a shuffle."""
    kept = F.col("__ledger.fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0
    return annotate(docs, text).where(kept).drop("__ledger")


class _Sql(str):
    """A piece of SQL: renders the rules' conditions."""

    def __mul__(self, n):
        return _Sql(f"{n} * {self}")

    def __lt__(self, other):
        return _Sql(f"({self} < {other})")

    def __gt__(self, other):
        return _Sql(f"({self} > {other})")

    def __ge__(self, other):
        return _Sql(f"({self} >= {other})")

    def __and__(self, other):
        return _Sql(f"({self} AND {other})")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the ledger of all documents under the policy text-1."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "text-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(mask("base-1")).cast("long")) != 0).alias("base_failed"), "kept", "n_lines", "n_upper", "n_letters", "n_marks", "fail_bits", "n_failed", "only_rule")


def sql() -> str:
    """DuckDB SQL for the rows of op1."""
    names = {m: _Sql(m) for m in MEASURES}
    bits = " + ".join(f"CASE WHEN {failed(names)} THEN {1 << bit} ELSE 0 END" for bit, failed in RULES.values())
    only = " ".join(f"WHEN {1 << RULES[r][0]} THEN '{r}'" for r in POLICIES["text-1"])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g2 AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS s FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g2),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g3 WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask("base-1")}) <> 0 AS base_failed, (fail_bits & {mask("text-1")}) = 0 AS kept,
       n_lines, n_upper, n_letters, n_marks, fail_bits, bit_count(fail_bits & {mask("text-1")})::BIGINT AS n_failed, CASE fail_bits & {mask("text-1")} {only} END AS only_rule FROM b"""
