import base64
import hashlib
import importlib.util
import sys

import public_tokenizers as P
import pytest
import tiktoken

from meterloom.llm import centroid_lang, quality_rules
from tests.llm.test_decontam import brute as held_items
from tests.llm.test_quality_rules import plain as measures
from tests.llm.test_simhash import brute as classes
from tests.llm.test_simhash import plain as fingerprint

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None


def expected(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = centroid_lang.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").where(~centroid_lang.held_out()))
    docs = [d for d, j in zip(docs, centroid_lang._judge([d[1] for d in docs], model), strict=True) if not j[2]]
    wanted = quality_rules.mask("text-1")
    docs = [d for d in docs if not sum(1 << b for b, f in quality_rules.RULES.values() if f(dict(zip(quality_rules.MEASURES, measures(d[1]), strict=True)))) & wanted]
    roots = classes([(d[0], fingerprint(d[1])) for d in docs])
    docs = [d for d, c in zip(docs, roots, strict=True) if d[0] == c]
    docs = [d for d in docs if not held_items(items, d[1])]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    out = set()
    for k, text, _ in docs:
        ids = encoding.encode_ordinary(text)
        out.add((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.skipif(pipeline is None, reason="the pipeline's file has been removed")
def test_pipeline_against_plain_code(spark, sf_dir):
    got = pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == expected(spark, sf_dir) and len(got) > 50


@pytest.mark.skipif(pipeline is None, reason="the pipeline's file has been removed")
def test_stages_on_odd_tables(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1), (1, None, "en", "s", 0, 1), (None, "Some fair words are here, and more of them follow in this line.", None, None, None, 2), (3, "", "de", "s", 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for table in (docs, docs.limit(0)):
        rows = table
        for _, stage in pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == docs.columns
        pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
    for _, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()


def test_library_does_not_import_the_subpackage():
    import os
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys, meterloom.catalog as c; c.queries(); c.oracle_sql(); assert not [m for m in sys.modules if m.startswith('meterloom.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
