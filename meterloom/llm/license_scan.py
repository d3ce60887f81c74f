"""Licence scans by template markup (operator 8).

A template is mandatory wording with two kinds of markup: ``[[ ... ]]`` is optional wording and
``{name:k}`` stands for up to k words of any kind. Templates are compiled to token automata; a place
of a text matches where an automaton reaches its end with all mandatory words exactly as given. Of several
ends from one place the longest counts. TEMPLATES holds whole licences and the notices that name one.

A label of GENERAL names a family by its opening words; it is dropped where a licence of the family matches.

Texts that lack a word which every template or phrase needs are not given to the automata: those words
are derived from the compiled templates (``anchors``).

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A null or empty text has no
words, no labels and score 0. Very long texts are scanned whole; the automata's work at a place is bounded by the
template. Labels are sorted, so matches that tie in place need no order. Rows are scanned one by one, repeated or not; an empty
table gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase -> label of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = (
    "this software is provided {by:20} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {holder:20} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {what:3} to deal in the {what:3} without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the {what:3} and to permit persons to whom the {what:3} is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the {what:3} "
    "the {what:3} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {holder:12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the {what:3} or the use or other dealings in the {what:3}"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {holder:8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {holder:8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "[[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "[[ 2 ]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "[[ 3 ]] this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {address:8} "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu LESSER general public license as published by the free software foundation either version VERSION of the license or at your option any later version "
    "[[ {program:6} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu LESSER general public license for more details ]]"
)

#: (label, template). Fixed wording of public licences and of their usual notices.
TEMPLATES = [
    ("gpl-3.0", "gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 3"),
    ("gpl-2.0", "gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 2"),
    ("gpl-3.0-or-later", _GNU.replace("LESSER ", "").replace("VERSION", "3")),
    ("gpl-2.0-or-later", _GNU.replace("LESSER ", "").replace("VERSION", "2")),
    ("lgpl-3.0", "gnu lesser general public license [[ as published by the free software foundation ]] [[ either ]] version 3"),
    ("lgpl-2.1", "gnu lesser general public license [[ as published by the free software foundation ]] [[ either ]] version 2 1"),
    ("lgpl-3.0-or-later", _GNU.replace("LESSER", "lesser").replace("VERSION", "3")),
    ("lgpl-2.1-or-later", _GNU.replace("LESSER", "lesser").replace("VERSION", "2 1")),
    ("agpl-3.0", "gnu affero general public license [[ as published by the free software foundation ]] [[ either ]] version 3"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 [[ or later ]] [[ only ]]"),
    ("gpl-2.0", "spdx license identifier gpl 2 0 [[ or later ]] [[ only ]]"),
    ("apache-2.0", "licensed under the apache license [[ version ]] 2 0"),
    ("apache-2.0", "apache license version 2 0 [[ january 2004 ]]"),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international [[ public ]] license"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international [[ public ]] license"),
    ("cc0-1.0", "cc0 1 0 universal"),
    ("mit", "[[ released ]] [[ licensed ]] under the mit license"),
    ("mit", _MIT),
    ("isc", _ISC),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", _BSD + _AS_IS),
    ("bsd-3-clause", _BSD + "[[ 3 ]] neither the name of {holder:12} nor the names of {holder:6} contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _AS_IS),
    ("bsd-3-clause", "neither the name of {holder:12} nor the names of {holder:6} contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 [[ if a copy of the mpl was not distributed with this file you can obtain one at {address:8} ]]"),
    ("all-rights-reserved", "[[ copyright {holder:8} ]] all rights reserved"),
]
#: Label of a family's opening words -> labels of its licences.
GENERAL = {"bsd": ("bsd-2-clause", "bsd-3-clause")}
LOWER, WORD = {c: c + 32 for c in range(65, 91)}, rb"[0-9a-z\x80-\xff]+"


class Automaton:
    """A template as states; each state has steps on a word, steps on any word, and free steps."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        at, opened = 0, []
        for token in template.split():
            if token == "[[":
                opened.append(at)
                at = self._step(free=at)
            elif token == "]]":
                end = self._step(free=at)
                self.free[opened.pop()].append(end)
                at = end
            elif m := re.fullmatch(r"\{\w+:(\d+)\}", token):
                ends = [at]
                for _ in range(int(m[1])):
                    self.any[ends[-1]] = new = self._step()
                    ends.append(new)
                at = self._step()
                for e in ends:
                    self.free[e].append(at)
            else:
                self.words[at][token.encode()] = new = self._step()
                at = new
                self.mandatory += [token] if not opened else []
        self.end = at
        if not self.mandatory:
            raise ValueError("a template needs mandatory words")
        start = self._closure({0})
        self.starts = {w for s in start for w in self.words[s]} if not any(self.any[s] is not None for s in start) else None

    def _step(self, free: int | None = None) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        if free is not None:
            self.free[free].append(len(self.words) - 1)
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def match(self, tokens: list[bytes], begin: int) -> int | None:
        """End (excluded) of the longest match from a place, or None."""
        states, best, at = self._closure({0}), None, begin
        while True:
            if self.end in states:
                best = at
            if at >= len(tokens) or not states:
                return best
            token = tokens[at]
            after = {self.words[s][token] for s in states if token in self.words[s]} | {self.any[s] for s in states if self.any[s] is not None}
            states, at = self._closure(after), at + 1


def compiled(templates=None):
    return [(label, Automaton(t)) for label, t in (TEMPLATES if templates is None else templates)]


def anchors(automata) -> list[bytes]:
    """Words such that every template and every phrase needs one of them: always the one that most of those left need, the longest on ties."""
    todo, out = [set(a.mandatory) for _, a in automata] + [set(p.split()) for p in PHRASES], []
    while todo:
        words = {w for need in todo for w in need}
        best = max(words, key=lambda w: (sum(w in need for need in todo) * min(len(w), 4), len(w), w))
        out.append(best.encode())
        todo = [need for need in todo if best not in need]
    return out


def specific(labels: set[str]) -> set[str]:
    """Labels without the families of which a licence is among them."""
    return {x for x in labels if not labels.intersection(GENERAL.get(x, ()))}


def strength(automaton: Automaton) -> float:
    """Score of a text that an automaton accepts: the nearer to 1, the more mandatory words it has."""
    return round(1 - 1 / (1 + len(automaton.mandatory)), 6)


def scan_text(text: str | None, automata, needed=None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Words, base places (start, label) and template matches (start, end, label, strength) of one text."""
    import numpy as np

    raw = text.translate(LOWER).encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return 0, [], []
    codes = np.frombuffer(raw, np.uint8)
    is_word = (codes >= 128) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    n = int(is_word[0]) + int(np.count_nonzero(is_word[1:] & ~is_word[:-1]))
    if not any(a in raw for a in (anchors(automata) if needed is None else needed)):
        return n, [], []
    tokens = re.findall(WORD, raw)
    places: dict[bytes, list[int]] = {}
    for i, t in enumerate(tokens):
        places.setdefault(t, []).append(i)
    base = []
    for phrase, label in PHRASES.items():
        words = phrase.encode().split()
        base += [(i, label) for i in places.get(words[0], ()) if tokens[i : i + len(words)] == words]
    found = []
    for label, automaton in automata:
        starts = range(n) if automaton.starts is None else sorted(i for w in automaton.starts for i in places.get(w, ()))
        found += [(i, end, label, strength(automaton)) for i in starts if (end := automaton.match(tokens, i))]
    kept = specific({x[2] for x in found})
    return n, sorted(base), sorted(x for x in found if x[2] in kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base (start, label), matches (start, stop, label) and score of every row.

    score is the largest strength of the templates that match, 0.5 where only a phrase does, else 0.
    """
    from pyspark.sql import types as T

    base = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]))
    matches = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("label", T.StringType())]))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("base", base), T.StructField("matches", matches), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        automata = compiled()
        needed = anchors(automata)
        one = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        two = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            rows = [scan_text(t, automata, needed) for t in batch.column(1).to_pylist()]
            scores = [max((x[3] for x in r[2]), default=0.5 if r[1] else 0.0) for r in rows]
            bases = [[dict(zip(("start", "label"), x, strict=True)) for x in r[1]] for r in rows]
            found = [[dict(zip(("start", "stop", "label"), x[:3], strict=True)) for x in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(bases, one), pa.array(found, two), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: licence labels of all documents."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        named(F.col("base.label")).alias("base_labels"), named(F.concat("base.label", "matches.label")).alias("labels"), "score",
    )


def template_regex(template: str) -> str:
    """The template as a regular expression over words that each end in a blank (for the SQL twin)."""
    out = []
    for token in template.split():
        m = re.fullmatch(r"\{\w+:(\d+)\}", token)
        out.append("(?:" if token == "[[" else ")?" if token == "]]" else f"(?:[^ ]+ ){{0,{m[1]}}}" if m else f"{token} ")
    return " " + "".join(out)


def sql() -> str:
    """DuckDB SQL for the rows of op8."""
    places = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'s': i, 'l': '{label}'}})")
    automata = compiled()
    labels = [f"CASE WHEN regexp_matches(n, '{template_regex(t)}') THEN {{'l': '{label}', 's': {strength(a)!r}::DOUBLE}} END" for (label, t), (_, a) in zip(TEMPLATES, automata, strict=True)]
    general = " OR ".join(f"(x.l = '{g}' AND list_has_any(list_transform(m, lambda y: y.l), {list(own)}))" for g, own in GENERAL.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS n FROM d),
a AS (SELECT doc_id, w, {' || '.join(f'({x})' for x in places)} AS b, list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL) AS m FROM p),
b AS (SELECT doc_id, w, b, list_filter(m, lambda x: NOT ({general})) AS m FROM a)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda x: x.s))::BIGINT AS first_word, list_max(list_transform(b, lambda x: x.s))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.l) || list_transform(m, lambda x: x.l))), ',') AS labels,
       CASE WHEN len(m) > 0 THEN list_max(list_transform(m, lambda x: x.s)) WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM b"""
