"""Language identification by nearest centroids (operator 9).

A text becomes a vector of hashed byte bigrams and trigrams of its lower-cased letters, weighted by
square-rooted frequency and inverse document frequency and scaled to length 1. Every language has
several centroids, found by spherical k-means, and a text gets the language of the nearest one by
cosine. A text is rejected where even that cosine lies below the floor of its language and length.

Floors. Short texts lie farther from every centroid, so each language has a floor for every doubling of
the number of n-grams. Half of the sample's rows are compared with centroids of the other half, as they are and
thinned to each smaller length; the floor is FLOOR_SHARE of the cosine that all but FLOOR_QUANTILE of them reach.

Document frequencies and language counts cover all learning rows. The centroids are fitted on a
sample of at most about ``sample_rows`` rows, the same number of each language, chosen by a hash; of more than
MOST_LANGUAGES languages the most frequent ones are learned.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Very long texts are read whole. With no
learning rows all texts are ``und``. Repeated rows are judged alike and teach as often as they occur; empty tables give no
rows; ties go to the language that sorts first. Extra columns are dropped by ``predict``, whatever their names, and pass through
``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import common

DIMS = 4096
SAMPLE_ROWS = 2400
CENTROIDS = 4
MOST_LANGUAGES = 400
UNKNOWN = "und"
#: Share of the low quantile of left-out cosines that a text must reach.
FLOOR_SHARE, FLOOR_QUANTILE = 0.5, 0.005
#: Left-out rows of a language that set its floors, and doublings of length that have one.
FLOOR_ROWS, FLOORS = 200, 20


def counts(text: str):
    """Hashed n-gram counts of a text, or None where it has no letter."""
    import numpy as np

    low = text.lower()
    if not any(map(str.isalpha, low[:200])) and not any(map(str.isalpha, low)):
        return None
    raw = low.encode("utf-8", "surrogatepass")
    keep = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
    c = np.frombuffer(b" " + raw.translate(keep) + b" ", np.uint8).astype(np.uint32)
    two = c[:-1] * np.uint32(257) + c[1:]
    three = two[:-1] * np.uint32(263) + c[2:] + np.uint32(1)
    found = np.bincount(two * np.uint32(2654435761) >> np.uint32(20), minlength=DIMS)
    return found + np.bincount(three * np.uint32(2654435761) >> np.uint32(20), minlength=DIMS)


def vector(found, idf):
    import numpy as np

    v = np.sqrt(found.astype(np.float32)) * idf
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else v


def _frequencies(learn: DataFrame):
    """Document frequency of every bin over all learning rows, and the number of rows with a letter."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (found := counts(text)) is not None:
                    df += found > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array(np.concatenate([[n], df]))], names=["bin", "n"])

    rows = learn.select("__text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    df, n = np.zeros(DIMS, np.int64), 0
    for r in common.bounded(rows, DIMS + 1, "bins"):
        if r.bin < 0:
            n = r.n
        else:
            df[r.bin] = r.n
    return df, n


def _sample(learn: DataFrame, sample_rows: int):
    """(language, counts) of the sampled rows: each language at a rate that gives its share of sample_rows."""
    import numpy as np

    counted = learn.groupBy(F.col("__lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.lang: r.n for r in counted.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return []
    each = max(1, sample_rows // len(sizes))
    drawn = F.coalesce(*[F.when(F.col("__lang") == lang, common.sampled(each, n, "__key", F.lit("sample"))) for lang, n in sizes.items()], F.lit(False))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(lang, c.astype(np.float32).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text and (c := counts(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=["lang", "counts"])

    rows = learn.where(drawn).select("__lang", "__text").mapInArrow(run, "lang string, counts binary")
    found = common.bounded(rows, 4 * sample_rows + 100, "sampled rows")
    return sorted((r.lang, bytes(r.counts)) for r in found)


def _kmeans(x, k: int, rounds: int = 12):
    """Spherical k-means from spread-out rows; returns unit centroids."""
    import numpy as np

    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        held = np.array(centres)
        held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-9)
        centres.append(x[int((x @ held.T).max(axis=1).argmin())])
    c = np.array(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> dict:
    """A model from labelled rows: idf, centroids, their languages and the floor."""
    import numpy as np

    learn = rows.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang")).where("__text IS NOT NULL AND __lang IS NOT NULL")
    df, n = _frequencies(learn)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    found = _sample(learn, sample_rows)
    names = sorted({x[0] for x in found})
    parts, langs, floors = [], [], {}
    for name in names:
        own = [np.frombuffer(c, np.float32) for lang_, c in found if lang_ == name]
        x = np.array([vector(c, idf) for c in own])
        c = _kmeans(x, centroids)
        parts.append(c)
        langs += [name] * len(c)
        floors[name] = _floors(own[1::2][:FLOOR_ROWS], _kmeans(x[::2], centroids), idf)
    return {"idf": idf, "centroids": np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, DIMS), np.float32), "langs": langs, "floors": floors}


def size_class(n: float) -> int:
    """Doublings of the number of n-grams."""
    return min(int(n).bit_length(), FLOORS - 1)


def _floors(left_out, centres, idf) -> list[float]:
    """The floor of every size class, from counts of rows that the centres have not seen."""
    import numpy as np

    rng = np.random.default_rng(7)
    cosines: list[list[float]] = [[] for _ in range(FLOORS)]
    for c in left_out:
        at, total = np.flatnonzero(c), float(c.sum())
        for k in range(2, size_class(total) + 1):
            thin = c
            if k < size_class(total):
                thin = np.zeros_like(c)
                thin[at] = rng.binomial(c[at].astype(np.int64), min(1.0, 2**k / 1.5 / total))
            if thin.any():
                cosines[k].append(float((centres @ vector(thin, idf)).max()))
    out, floor = [], 0.0
    for found in cosines:
        if len(found) >= 10:
            floor = max(floor, FLOOR_SHARE * float(np.quantile(found, FLOOR_QUANTILE)))
        out.append(floor)
    return out


def _judge(texts, model):
    """(language, score, rejected) of each text."""
    import numpy as np

    out = []
    for text in texts:
        found = counts(text) if text and model["langs"] else None
        if found is None:
            out.append((UNKNOWN, 0.0, True))
            continue
        near = model["centroids"] @ vector(found, model["idf"])
        best = int(np.argmax(near))
        score = min(1.0, max(0.0, float(near[best])))
        lang = model["langs"][best]
        out.append((lang, score, score < model["floors"][lang][size_class(found.sum())]))
    return out


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and rejected of every row."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = _judge(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]], names=schema.names)

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, without a shuffle."""
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([not r[2] for r in _judge(batch.column(at).to_pylist(), model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """True for the rows that never teach: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the language of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
