import itertools

import numpy as np
import pytest

from meterloom.llm import line_crf as c


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2])
    scores, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs, log_z = c.forward_backward(scores, lengths, trans)
    want_good, want_pairs, at = [], np.zeros((2, 2)), 0
    for k, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(scores[at + i] for i in range(n) if p[i]) + sum(trans[p[i - 1], p[i]] for i in range(1, n)) for p in paths])
        assert abs(np.log(w.sum()) - log_z[k]) < 1e-9
        w /= w.sum()
        want_good += [sum(x for x, p in zip(w, paths, strict=True) if p[i]) for i in range(n)]
        for x, p in zip(w, paths, strict=True):
            for i in range(1, n):
                want_pairs[p[i - 1], p[i]] += x
        at += n
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs)


def test_long_chains_stay_finite():
    good, pairs, log_z = c.forward_backward(np.full(20000, -30.0), np.array([20000]), np.zeros((2, 2)))
    assert np.isfinite(log_z).all() and good.max() < 1e-6 and abs(pairs.sum() - 19999) < 1


def test_features_of_odd_texts():
    for text in (None, "", "\n \n", "a", "x" * 100000, "é\n" * 3, "\x00 \x1f", "a b c d e\n" * 3):
        f, chars = c.line_features(text)
        assert f.shape == (len(chars), c.FEATURES) and np.isfinite(f).all() and (chars > 0).all()
    assert c.line_features("a b c d e\n" * 3)[0][:, 3].tolist() == [0, 1, 1]


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = c.query(spark, d).join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 40
    assert np.mean([r.quality == r.predicted for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert c.query(spark, d).count() == docs.count()
    assert {r.doc_id for r in c.query(spark, d).where("held_out").collect()} == {r.doc_id for r in docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).collect()}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 0), (2, None)]])
def test_without_two_kinds_of_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some words\nhere", 2.0), (1, "some words\nhere", 2.0), (2, None, 1.0), (None, "", 0.0)], "doc_id long, text string, score double")
    model = c.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in c.predict(docs, model).collect()] == [model["share"]] * 4
    assert c.predict(docs.limit(0), model).count() == 0


def test_odd_rows_are_scored(spark):
    rows = [(i, "fine words stand here, one after another.\n" * (i % 5 + 1)) for i in range(60)] + [(100 + i, "###%%% $$$ &&& ***\n" * (i % 4 + 1)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "word " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in c.predict(docs, c.fit(docs, labels)).collect()}
    assert all(got[k].predicted == (k < 100) for k, _ in rows) and got[500].score == got[501].score < 0.5 and len(got) == 123


def test_the_chain_beats_lines_judged_alone():
    """Lines whose own features are weak: neighbours decide, and only transitions carry them further than one line."""
    rng = np.random.default_rng(4)
    lengths = np.full(120, 30)
    labels = np.arange(120) % 2
    y = np.repeat(labels, lengths)
    f = np.stack([rng.normal(size=len(y)) + 0.7 * (2 * y - 1), np.ones(len(y))], axis=1)
    got = {chain: c.forward_backward(f @ m["w"], lengths, m["trans"])[0] for chain in (True, False) for m in [c.train(f, lengths, labels, chain=chain)]}
    right = {chain: np.mean((g > 0.5) == y) for chain, g in got.items()}
    assert right[True] >= right[False] + 0.05 and right[True] > 0.85


def test_training_climbs_the_likelihood():
    """The gradient of the regularised conditional likelihood, summed over all paths, vanishes at the trained weights."""
    rng = np.random.default_rng(1)
    lengths = np.array([3, 2, 4, 1, 3, 4])
    labels = np.array([1, 0, 1, 0, 0, 1])
    f = rng.normal(size=(lengths.sum(), 2)) + np.repeat(labels, lengths)[:, None]

    def objective(w, trans):
        total, at = 0.0, 0
        for n, label in zip(lengths, labels, strict=True):
            scores = f[at : at + n] @ w
            paths = list(itertools.product((0, 1), repeat=int(n)))
            each = [sum(scores[i] for i in range(n) if p[i]) + sum(trans[p[i - 1], p[i]] for i in range(1, n)) for p in paths]
            own = sum(scores) * label + (n - 1) * trans[label, label]
            total += own - np.log(np.exp(each).sum())
            at += n
        return total / len(f) - 1e-3 / 2 * (w**2).sum() - c.HOLD / 2 * (trans**2).sum()

    m = c.train(f, lengths, labels, rounds=600)
    best = objective(m["w"], m["trans"])
    for _ in range(40):
        w, t = rng.normal(size=2) * 0.2, rng.normal(size=(2, 2)) * 0.2
        assert objective(m["w"] + w, m["trans"] + t) <= best + 1e-3


def test_repeated_ids_teach_with_their_smallest_text(spark):
    rows = [(i, ("good words in a line\n" if i % 2 else "$$$ ||| >>>\n") * 3) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = [(i, "zzz " + t) for i, t in rows]
    once = c.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    for n in (1, 4):
        again = c.fit(spark.createDataFrame(more + rows, "doc_id long, text string").repartition(n), labels)
        assert np.allclose(again["w"], once["w"]) and np.allclose(again["curve"], once["curve"])
