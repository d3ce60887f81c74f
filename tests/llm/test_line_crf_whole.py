import random

from meterloom.llm import line_crf as c


def long_documents(spark):
    """Documents that differ only after their 400th line."""
    rng = random.Random(2)
    same = ["Lines of every document alike, 12345."] * 420
    good = lambda: " ".join(rng.choices(["the", "house", "stands", "near", "a", "river", "and", "we", "walk"], k=14)).capitalize() + "."
    bad = lambda: rng.choice(["$$$ >>> CLICK", "||| 0x 99 ///", "!!! ### WIN"]) * 2
    rows = [(i, "\n".join(same + [(good if i % 2 else bad)() for _ in range(300)])) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")


def test_late_lines_teach(spark):
    docs, labels = long_documents(spark)
    got = c.predict(docs, c.fit(docs, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 57


def test_documents_beyond_the_bound_stay_out_whole(spark, monkeypatch):
    docs, labels = long_documents(spark)
    monkeypatch.setattr(c, "MOST_LINES", 30 * 720 + 5)
    seen, train = [], c.train
    monkeypatch.setattr(c, "train", lambda f, n, y: seen.extend(n.tolist()) or train(f, n, y))
    c.fit(docs, labels)
    assert seen == [720] * 30
