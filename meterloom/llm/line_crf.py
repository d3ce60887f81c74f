"""Quality classifier: a linear-chain conditional random field over lines (operator 2).

Every line with a word is a variable, good or bad. Its score is linear in features of the line and
of its two neighbours; transitions score adjacent pairs. Forward-backward gives each line's marginal;
a document's quality is their mean weighted by line length, mapped to a probability by a logistic
curve that is fitted on the learning sample.

The field is learned from document labels: all lines of a sampled document carry its label, so the learned
chains never change their label and nothing but a penalty (HOLD) keeps the transitions finite. They
then act as a smoother: a line among bad ones needs stronger evidence of its own to count as good.
The sample is bounded: about SAMPLE_ROWS labelled documents, chosen by a hash, each with all its lines.
Documents that would make them more than MOST_LINES lines stay out whole.
Scoring covers all lines of all texts. Inputs are the text alone.

A null, empty or blank text has no lines; its line mean counts as 0. Very long texts are scored whole.
Documents labelled several times count with their smallest label; of learning documents that share a key the
smallest text teaches; null labels and keys don't teach. With no labels, or labels of one kind only, every score is that
kind's share (0.5 without labels). Repeated rows and ties are scored alike; empty tables give no rows. Extra columns
are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import common

SAMPLE_ROWS = 4000
MOST_LINES = 600_000
#: Penalty of the transitions.
HOLD = 0.05
OWN, SHARED = 14, 8  # features of a line; those of them that its neighbours also lend
FEATURES = OWN + 2 * SHARED + 2
THRESHOLD = 0.3


def line_features(text: str | None):
    """(features, lengths in characters) of the lines of a text that have a word."""
    import numpy as np

    raw_lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    if not raw_lines:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0)
    n = len(raw_lines)
    raw = b"\n".join(raw_lines) + b"\n"
    sizes = np.fromiter(map(len, raw_lines), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kinds = np.frombuffer(raw, np.uint8)
    kinds = _classes()[kinds]
    per = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(1, 8)], axis=1).astype(np.float64)
    upper, lower, digit, symbol, mark, stop, follow = per.T
    words = [x.split() for x in raw_lines]
    n_words = np.fromiter(map(len, words), np.int64, n).astype(float)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    seen: set[bytes] = set()
    again = np.zeros(n)
    for i, x in enumerate(raw_lines):
        if x in seen:
            again[i] = 1
        seen.add(x)
    repeated = _repeated(words, n_words.astype(np.int64))
    chars = np.maximum(sizes - follow, 1)
    letters = np.maximum(upper + lower + follow, 1)
    f = np.zeros((n, FEATURES), np.float32)
    f[:, 0] = np.minimum(symbol / n_words, 2)
    f[:, 1] = upper / letters
    f[:, 2] = np.minimum(mark / n_words, 2)
    f[:, 3] = again
    f[:, 4] = 1 - distinct / n_words
    f[:, 5] = repeated / n_words
    f[:, 6] = np.log1p(chars) / 5
    f[:, 7] = digit / chars
    f[:, 8] = np.minimum(stop / n_words, 1)
    f[:, 9] = np.minimum(letters / n_words / 8, 3)
    f[:, 10] = n_words < 4
    f[:, 11] = [x.rstrip()[-1:] in b".,;:!?\"'" for x in raw_lines]
    f[:, 12] = [x.lstrip()[:1].isalpha() for x in raw_lines]
    f[:, 13] = 1
    f[1:, OWN : OWN + SHARED] = f[:-1, :SHARED]
    f[:-1, OWN + SHARED : OWN + 2 * SHARED] = f[1:, :SHARED]
    f[0, -2] = 1
    f[-1, -1] = 1
    return f, chars.astype(float)


def _classes():
    """Kind of every byte: 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 stop, 7 byte that follows or leads in UTF-8."""
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58] = 1, 2, 3
    kinds[[ord(c) for c in "#*$%&|<>@=+^~\\/{}[]_"]] = 4
    kinds[[ord(c) for c in "!?"]] = 5
    kinds[[ord(c) for c in ".,;:"]] = 6
    kinds[128:192] = 7
    kinds[192:] = 2
    return kinds


def _repeated(words, n_words, width: int = 5):
    """Words of each line that lie in windows of five words found before or after in the text."""
    import numpy as np

    flat = [w for line in words for w in line]
    n = len(flat) - width + 1
    out = np.zeros(len(flat), bool)
    if n > 1:
        codes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
        keys = np.zeros(n, np.uint64)
        for i in range(width):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
            keys ^= keys >> np.uint64(29)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twin = np.zeros(n, bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            for i in range(width):
                out[i : i + n] |= twin
    return np.add.reduceat(out.astype(np.int64), np.concatenate([[0], np.cumsum(n_words)[:-1]]))


def forward_backward(scores, lengths, trans):
    """Marginals of the good state, expected transitions and log-partition of several chains.

    scores: good minus bad of all lines, chain after chain; trans[i, j]: score of state i before j.
    """
    import numpy as np

    k = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    emit = np.stack([np.zeros_like(scores), scores], axis=1)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    e = np.exp(trans)
    log_z = np.zeros(k)
    longest = int(size[0]) if k else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(longest):
        at = starts[: active[t]] + t
        if t:
            prev = alpha[at - 1]
            top = prev.max(axis=1, keepdims=True)
            alpha[at] = np.log(np.exp(prev - top) @ e) + top + emit[at]
        else:
            alpha[at] = emit[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = beta[at + 1] + emit[at + 1]
        top = after.max(axis=1, keepdims=True)
        beta[at] = np.log(np.exp(after - top) @ e.T) + top
    last = starts + size - 1
    top = alpha[last].max(axis=1)
    log_z[order] = np.log(np.exp(alpha[last] - top[:, None]).sum(axis=1)) + top
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    pairs = np.zeros((2, 2))
    if longest > 1:
        inner = np.ones(len(scores), bool)
        inner[(np.cumsum(lengths) - lengths)] = False
        at = np.flatnonzero(inner)
        z = np.repeat(log_z, lengths)[at]
        for i in range(2):
            for j in range(2):
                pairs[i, j] = np.exp(np.minimum(alpha[at - 1, i] + trans[i, j] + emit[at, j] + beta[at, j] - z, 0)).sum()
    return good, pairs, log_z


def train(features, lengths, labels, rounds: int = 120, decay: float = 1e-3, chain: bool = True) -> dict:
    """Weights and transitions of the largest regularised conditional likelihood (adaptive gradient steps).

    Without `chain` the transitions stay 0: every line is judged by its own features.
    """
    import numpy as np

    n = max(1, len(features))
    y = np.repeat(labels, lengths).astype(float)
    w, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(features), bool)
    inner[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    for step in range(1, rounds + 1):
        good, pairs, _ = forward_backward(features @ w, lengths, trans)
        g_w = features.T @ (y - good) / n - decay * w
        g_t = (seen - pairs) / n - HOLD * trans  # labels never change within a document: hold the transitions back
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w**2
        m_t, v_t = 0.9 * m_t + 0.1 * g_t, 0.99 * v_t + 0.01 * g_t**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w += 0.15 * (m_w / fix1) / (np.sqrt(v_w / fix2) + 1e-8)
        trans += chain * 0.05 * (m_t / fix1) / (np.sqrt(v_t / fix2) + 1e-8)
    return {"w": w, "trans": trans}


def document_means(features, chars, lengths, model):
    """Length-weighted mean marginal of each document; 0 without lines."""
    import numpy as np

    out = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        good, _, _ = forward_backward(features @ model["w"], lengths[some], model["trans"])
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some] = np.add.reduceat(good * chars, starts) / np.add.reduceat(chars, starts)
    return out


def _curve_inputs(means):
    import numpy as np

    p = np.clip(means, 1e-4, 1 - 1e-4)
    return np.stack([np.ones_like(p), np.log(p / (1 - p))], axis=1)


def fit_curve(means, labels, rounds: int = 60):
    """Logistic curve from line means to the probability of label 1 (damped Newton steps)."""
    import numpy as np

    x, b = _curve_inputs(means), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (labels - p) - 1e-2 * b)
        b += step / max(1.0, float(np.abs(step).max()) / 2)
    return b


def _score(texts, model):
    import numpy as np

    if model["curve"] is None:
        return np.full(len(texts), model["share"])
    out = []
    for begin in range(0, len(texts), 512):
        found = [line_features(t) for t in texts[begin : begin + 512]]
        lengths = np.array([len(f) for f, _ in found], np.int64)
        means = document_means(np.concatenate([f for f, _ in found]).astype(float), np.concatenate([c for _, c in found]), lengths, model)
        out.append(1 / (1 + np.exp(-np.clip(_curve_inputs(means) @ model["curve"], -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model from labelled documents; labels holds key and label (0 or 1) of learning rows only."""
    import numpy as np

    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    known = known.where(common.sampled(sample_rows, known.count(), "k", F.lit("crf")))
    sample = common.bounded(known, 2 * sample_rows + 100, "sampled labels")
    share = sum(r.y for r in sample) / len(sample) if sample else 0.5
    model = {"w": None, "trans": None, "curve": None, "share": share}
    if not 0 < share < 1:
        return model
    drawn = F.broadcast(docs.sparkSession.createDataFrame([(r.k, r.y) for r in sample], known.schema))
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(drawn, "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [line_features(t) for t in batch.column(0).to_pylist()]
            whole = [(f.astype(np.float32).tobytes(), c.astype(np.float32).tobytes()) for f, c in found]
            n = pa.array([len(c) for _, c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), n, pa.array([x[0] for x in whole], pa.binary()), pa.array([x[1] for x in whole], pa.binary())], names=["k", "y", "n", "f", "c"])

    kind = known.schema["k"].dataType.simpleString()
    read = common.stash(rows.select("t", "k", "y").mapInArrow(run, f"k {kind}, y int, n long, f binary, c binary"), "crf-sample")
    sizes = common.bounded(read.select("k", "n", F.xxhash64("k", F.lit("crf lines")).alias("h")), 2 * sample_rows + 100, "sampled documents")
    if sum(r.n for r in sizes) > MOST_LINES:
        left, fit_in = MOST_LINES, []
        for r in sorted(sizes, key=lambda r: (r.h, r.k)):
            if r.n <= left:
                left -= r.n
                fit_in.append((r.k,))
        read = read.join(F.broadcast(docs.sparkSession.createDataFrame(fit_in, f"k {kind}")), "k")
    taken = sorted(common.bounded(read, 2 * sample_rows + 100, "sampled documents"), key=lambda r: r.k)
    if not taken:
        return model
    f = [np.frombuffer(r.f, np.float32).reshape(-1, FEATURES) for r in taken]
    lengths, y = np.array([len(x) for x in f], np.int64), np.array([r.y for r in taken])
    features, chars = np.concatenate(f).astype(float), np.concatenate([np.frombuffer(r.c, np.float32) for r in taken]).astype(float)
    some = lengths > 0
    model |= train(features, lengths[some], y[some])
    model["curve"] = fit_curve(document_means(features, chars, lengths, model), y)
    return model


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score and predicted of every row."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(batch.column(1).to_pylist(), model))], names=schema.names)

    rows = docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id"):
    """True for the rows that never teach: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the quality of all documents, learned from labels of those that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
