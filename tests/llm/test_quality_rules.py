import random

import duckdb

from meterloom.llm import quality_rules as q


def plain(text):
    import re

    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text), sum(c in "!?" for c in text))


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "ü" * 20000, "a b c d e " * 3, "a b c d e f a b c d e", "x\nx\n x\nx ", "#*$%&|<> !?", "A B\x0bC\x0cD\rE\x1cF\xa0G"]
    return out + [" ".join(rng.choices("abc", k=rng.randrange(40))) + rng.choice(["", "\n", "!\n#"]) * 3 for _ in range(60)]


def test_measures_against_plain_code():
    for t in texts():
        assert q.measure_text(t) == plain(t)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ledger_policies_and_filter(spark, tmp_path):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(3, "a", 7), (None, "b c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fail_bits int").repartition(3)
    ledger = q.ledger(docs)
    want = {}
    for _, t, _ in rows:
        m = dict(zip(q.MEASURES, plain(t), strict=True))
        want[t] = sum(1 << b for b, f in q.RULES.values() if f(m))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fail_bits) for r in ledger.collect())
    assert got == sorted((k is None, k or 0, want[t]) for k, t, _ in rows)
    for policy in q.POLICIES:
        kept = q.filter_documents(docs, policy)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not want[r.text] & q.mask(policy))
        own = [want[t] & q.mask(policy) for _, t, _ in rows]
        for r in q.ablate(ledger, policy).collect():
            bit = 1 << q.RULES[r.rule][0]
            assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(bool(x & bit) for x in own), own.count(bit), own.count(0) + own.count(bit))
        for r in q.apply_policy(ledger, policy).select("fail_bits", "kept", "n_failed", "only_rule").collect():
            failed = [rule for rule in q.POLICIES[policy] if r.fail_bits >> q.RULES[rule][0] & 1]
            assert (r.kept, r.n_failed, r.only_rule) == (not failed, len(failed), failed[0] if len(failed) == 1 else None)
    stored = q.write_ledger(docs, f"file://{tmp_path}/ledger")
    assert sorted(map(str, stored.collect())) == sorted(map(str, ledger.collect()))
    assert q.annotate(docs).columns == [*docs.columns, "__ledger"]
    assert sorted(str((r.text, r["__ledger"].fail_bits)) for r in q.annotate(docs).collect()) == sorted(str((t, want[t])) for _, t, _ in rows)
    assert q.ledger(docs.limit(0)).count() == 0 and q.filter_documents(docs.limit(0)).count() == 0
    assert q.ablate(q.ledger(docs.limit(0)), "text-1").count() == len(q.RULES)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = q.query(spark, sf_dir)
    want = con.sql(q.sql())
    assert rows_of(got.select(*want.columns)) == sorted(want.fetchall(), key=str)
