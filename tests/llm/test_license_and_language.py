import math
import random
import re
from collections import Counter

import duckdb

from meterloom.llm import centroid_lang as cl
from meterloom.llm import license_scan as ls

NOTICES = [
    None, "", "!!", "Licensed under the Apache License, Version 2.0.", "the GNU  General\nPublic-License as published by the Free Software Foundation, either version 3", "gnu general public license version 4",
    "CC BY-NC 4.0", "CC-BY 4.0, cc by sa 4 0", "mit license MIT License", "Released under the MIT License.", "Copyright (c) 2020 Some Body All rights reserved", "all right reserved", "licensed under the apache 2 0",
    "Neither the name of the Über Foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "neither the name of x nor names of y contributors may be used", "x " * 30000 + "cc by", "cc bycc by", "ICC BY 4.0", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
]


def test_scan_equals_its_sql(spark, tmp_path):
    rng = random.Random(2)
    parts = [w for n in NOTICES if n and len(n) < 300 for w in re.split(r"(?<= )", n)]
    texts = NOTICES + ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(200)] + [f"{rng.choice(NOTICES[3:12])} {rng.choice(NOTICES[3:12])}" for _ in range(50)] + [FULL_BSD.format(third=""), FULL_BSD.format(third=THIRD), FULL_MIT, NOTICES[-1] + " " + NOTICES[13], (FULL_MIT + "\n") * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ls.sql())
    got = ls.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert ls.scan(docs.limit(0)).count() == 0


def test_every_template_accepts_its_wording():
    for label, template in ls.TEMPLATES:
        full = re.sub(r"\{\w+:(\d+)\}", lambda m: "any " * int(m[1]), template.replace("[[", "").replace("]]", ""))
        least = re.sub(r"\{\w+:\d+\}", "", re.sub(r"\[\[[^\[\]]*\]\]", "", template))
        automata = ls.compiled()
        for text in (full, least):
            assert ls.specific({label, *(m[2] for m in ls.scan_text(text, automata)[2])}) == {m[2] for m in ls.scan_text(text, automata)[2]}
            assert label in {m[2] for m in ls.scan_text(text, automata)[2]} or label in ls.GENERAL
        words = least.split()
        own = [(label, ls.Automaton(template))]
        for i in range(len(words)):  # every mandatory word counts
            changed = " ".join([*words[:i], "zzz", *words[i + 1 :]])
            assert not any(m[1] - m[0] >= len(words) for m in ls.scan_text(changed, own)[2]), (label, words[i])


FULL_BSD = """Copyright (c) 2001, The Ünion of Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FULL_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licences():
    labels = lambda text: {m[2] for m in ls.scan_text(text, ls.compiled())[2]}
    assert labels(FULL_BSD.format(third="")) == {"bsd-2-clause", "all-rights-reserved"}
    assert labels(FULL_BSD.format(third=THIRD)) == {"bsd-3-clause", "all-rights-reserved"}
    assert labels(FULL_BSD.format(third="").replace("TORT", "DELICT")) == {"bsd", "all-rights-reserved"}
    assert labels("MIT License Copyright (c) 2020 A B " + FULL_MIT) == {"mit"} and labels(FULL_MIT.replace("sublicense", "lend")) == set()
    assert labels("Apache License Version 2.0, January 2004") == {"apache-2.0"}
    assert labels("the GNU Lesser General Public License version 2.1") == {"lgpl-2.1"}
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert labels(notice) == {"lgpl-3.0", "lgpl-3.0-or-later"} and labels(notice.replace("Lesser ", "")) == {"gpl-3.0", "gpl-3.0-or-later"}


def test_anchors_follow_the_templates():
    for more in ([], [("new", "some {x:3} wholly new wording"), ("odd", "[[ license ]] zyx")]):
        automata = ls.compiled(ls.TEMPLATES + more)
        found = ls.anchors(automata)
        assert all(any(a.decode() in automaton.mandatory for a in found) for _, automaton in automata)
        assert all(any(a.decode() in p.split() for a in found) for p in ls.PHRASES)
    assert [m[2] for m in ls.scan_text("Some wholly new wording", automata)[2]] == ["new"]


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = cl.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_of_odd_rows(spark):
    learn = [(i, x * 3, lang, 1) for i, (lang, x) in enumerate([("xx", "abra kadabra "), ("yy", "zzyx wyvern fjord ")] * 20)] + [(900, "no label", None, 1), (901, None, "xx", 1)]
    docs = spark.createDataFrame(learn, "doc_id long, text string, lang string, score int")
    model = cl.fit(docs)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "kadabra"), (4, "kadabra"), (None, "fjord wyvern " * 20000), (6, "中文" * 9), (7, "12 " * 100 + "wyvern")]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in cl.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert got[3] == got[4] == (4, "xx", False) and got[5] == (None, "yy", False) and got[6][1] in ("xx", "yy") and got[6][2]
    assert cl.filter_documents(docs, model).columns == docs.columns and cl.filter_documents(docs, model).count() == 40  # "no label" is far from both
    empty = cl.fit(docs.limit(0))
    assert {r.lang_pred for r in cl.predict(docs, empty).collect()} == {"und"} and cl.predict(docs.limit(0), model).count() == 0


def plain_grams(text):
    """Counts of the hashed bigrams and trigrams, one by one; None without a letter."""
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return None
    raw = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low.encode()) + b" "
    out = Counter()
    for i in range(len(raw) - 1):
        out[(raw[i] * 257 + raw[i + 1]) * 2654435761 % 2**32 >> 20] += 1
    for i in range(len(raw) - 2):
        out[((raw[i] * 257 + raw[i + 1]) * 263 + raw[i + 2] + 1) * 2654435761 % 2**32 >> 20] += 1
    return out


def test_languages_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = cl.fit(docs.where(~cl.held_out()))
    rows = docs.collect()
    learn = [g for r in docs.where(~cl.held_out()).collect() if r.text and r.lang and (g := plain_grams(r.text))]
    df = Counter(k for g in learn for k in g)
    idf = [math.log((1 + len(learn)) / (1 + df[k])) + 0.1 for k in range(cl.DIMS)]
    assert max(abs(a - b) for a, b in zip(idf, model["idf"], strict=True)) < 1e-5
    got = {r.doc_id: r for r in cl.predict(docs, model).collect()}
    for r in rows:
        g = plain_grams(r.text) if r.text else None
        if g is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0.0, True)
            continue
        v = {k: math.sqrt(n) * idf[k] for k, n in g.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(float(c[k]) * x for k, x in v.items()) / length for c in model["centroids"]]
        best = max(near)
        assert abs(got[r.doc_id].score - best) < 1e-4
        assert got[r.doc_id].lang_pred in {lang for lang, x in zip(model["langs"], near, strict=True) if x > best - 1e-5}
        floor = model["floors"][got[r.doc_id].lang_pred][cl.size_class(sum(g.values()))]
        assert abs(best - floor) < 1e-4 or got[r.doc_id].rejected == (best < floor)


def test_centroids_are_means_of_their_rows(spark):
    import numpy as np

    x = np.random.default_rng(2).random((200, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = cl._kmeans(x, 4, rounds=60)
    own = [max(range(4), key=lambda j: sum(a * b for a, b in zip(r, c[j], strict=True))) for r in x]
    for j in range(4):
        m = sum(r for r, o in zip(x, own, strict=True) if o == j)
        assert np.allclose(m / np.linalg.norm(m), c[j], atol=1e-6)


OTHERS = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "consonants": "zq wrtp kjx bvn mlqz prtw xkc dfgh jklm npqr stvw xzbc dfgj klmn prst vwxz qrtp kjxb vnml qzpr twxk cdfg hjkl mnpq rstv wxzb cdfg jklm nprs tvwx zqrt",
    "base64": "qRz8Kd0mVt3xWb7YpLs2Hc9JfNg4Tk1QeXu6Ao5RiZvMwBnDyGlCjEhSPqRz8Kd0mVt3xWb7YpLs2Hc9JfNg4Tk1QeXu6Ao5RiZvMwBnDyGlCjEhSP",
}


def test_unlearned_languages_are_rejected_and_clean_short_texts_kept(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = cl.fit(docs.where(~cl.held_out()))
    odd = spark.createDataFrame([(i, (t + " ") * n) for i, (t, n) in enumerate((t, n) for t in OTHERS.values() for n in (1, 20))], "doc_id long, text string")
    assert all(r.rejected for r in cl.predict(odd, model).collect())
    short = [(r.doc_id, " ".join(r.text.split()[a : a + 12])) for r in docs.where(cl.held_out()).collect() if r.text for a in (0, 40) if len(r.text.split()) > a + 12]
    kept = cl.filter_documents(spark.createDataFrame(short, "doc_id long, text string"), model).count()
    assert len(short) > 200 and kept >= 0.97 * len(short)


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(cl, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, f"word{lang} text{lang} ", lang) for i, lang in enumerate("aaabbbccd")], "doc_id long, text string, lang string")
    assert set(cl.fit(docs)["langs"]) == {"a", "b"}
