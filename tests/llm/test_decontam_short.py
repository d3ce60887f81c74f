from collections import Counter

from meterloom.llm import decontam as d
from tests.llm.test_decontam import make


def test_documents_shorter_than_an_item(spark):
    items = [(k, t) for k, t in make()[0] if t]
    rows = []
    for k, t in items:
        own = t.split()
        for gone in ([-1], [-3, -2, -1], [0], [len(own) // 2]):
            left = [w for i, w in enumerate(own) if i - len(own) not in gone and i not in gone]
            rows.append((len(rows), k, " ".join(left)))
    want = {}
    for doc, _, text in rows:
        words = d.words_of(text)
        for k, t in items:
            own = d.words_of(t)
            if len(words) < len(own):
                s = d.weighted_similarity(Counter(d.shingles_of(words)), Counter(d.shingles_of(own)))
                if s >= 0.8 - 1e-12:
                    want[doc, k] = (0, len(words), round(s, 9))
    assert len(want) > 50
    docs = spark.createDataFrame([(a, t) for a, _, t in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = {k: len(d.words_of(t)) for k, t in items}
    length = {a: len(d.words_of(t)) for a, _, t in rows}
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word, round(r.similarity, 9)) for r in d.matches(docs, bench).collect() if length[r.doc_id] < size[r.item_id]}
    assert got == want
    assert not {r.doc_id for r in d.remove(docs, bench).collect()} & {a for a, _ in want}
