"""Fingerprints and licences, which stay within Spark SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.llm import fingerprint, licenses

SCHEMA = "doc_id bigint, text string"


def test_no_python_in_the_plans(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (fingerprint.compare_with_edit(docs), licenses.scan(docs.withColumn("path", F.col("source")))):
        df.explain()
        text = capsys.readouterr().out
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_edits_and_order(spark):
    rng = random.Random(4)
    rows = [(k * 3, " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 60)))) for k in range(150)] + [(1_000_000_000, "far away"), (-5, "é" * 7), (10**15, None), (7, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).withColumn("n_chars", F.lit("clash")).repartition(5)
    got = {r.doc_id: r for r in fingerprint.compare_with_edit(df).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[doc_id].n_chars == len(text)
        if edited == text:
            assert got[doc_id].fingerprint == got[doc_id].edited_fingerprint and got[doc_id].near_edited == 1.0


def test_edge_tables(spark):
    lone = fingerprint.compare_with_edit(spark.createDataFrame([(3, "abcd")], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256) for r in lone] == [(3, hashlib.sha256(b"abab").hexdigest())]
    rows = [(1, "b b"), (1, "a a"), (1, "a a"), (None, "n n"), (2, "word " * 200_000)]
    assert fingerprint.compare_with_edit(spark.createDataFrame(rows, SCHEMA)).count() == 5
    assert fingerprint.compare_with_edit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    one = [rng.choice(words) for _ in range(3000)]
    two = one[:2000] + [rng.choice(words) for _ in range(1000)]
    df = spark.createDataFrame([(" ".join(one), " ".join(two), " ".join(one[:600]))], "a string, b string, c string")
    for name in "abc":
        df = fingerprint.with_fingerprint(df, name, f"f{name}")
    r = df.select(
        fingerprint.resemblance("fa", "fb").alias("near"), fingerprint.distinct_shingles("fa").alias("n"), fingerprint.containment("fc", "fa").alias("inside"),
        F.size("fa").alias("size"), fingerprint.resemblance("fa", "fa").alias("self"),
    ).first()
    assert r.near == pytest.approx(0.5, abs=0.15) and r.n == pytest.approx(2996, rel=0.3) and r.inside > 0.6 and r.size == 128 and r.self == 1.0


def test_merge_of_parts(spark):
    words = [f"w{k % 700}" for k in range(2000)]
    parts = [(1, " ".join(words[k : k + 104])) for k in range(0, 2000, 100)] + [(2, None), (3, "a"), (3, "b")]
    df = fingerprint.with_fingerprint(spark.createDataFrame(parts, "k bigint, text string"), "text", "f")
    merged = {r.k: r.f for r in fingerprint.merge(df, "k", "f").collect()}
    whole = fingerprint.with_fingerprint(spark.createDataFrame([(" ".join(words),)], "text string"), "text", "f").first().f
    assert merged[1] == whole and merged[2] == [] and len(merged[3]) == 2


FILES = [
    ("p/LICENSE", "Released under the MIT License."), ("p/a/x.py", "code\nno licence here"), ("p/a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    ("p/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("p/a/b/c/z.py", ""), ("q/z.py", None),
    ("top.py", "mit der\nunder the work"), ("pa/file.py", "text"), (None, "Released under the MIT License."),
]


def test_nearest_ancestor(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumn("licence", F.lit("clash")).withColumn("dir", F.lit("clash"))
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in licenses.scan(df.drop("dir")).collect()}
    assert got == {
        "p/LICENSE": ("MIT", "own", None), "p/a/x.py": ("MIT", "inherited", "p"), "p/a/y.py": ("Apache-2.0", "own", None),
        "p/a/b/COPYING.txt": ("GPL-3.0", "own", None), "p/a/b/c/z.py": ("GPL-3.0", "inherited", "p/a/b"), "q/z.py": (None, "none", None),
        "top.py": (None, "none", None), "pa/file.py": (None, "none", None), None: (None, "none", None),
    }
    assert licenses.scan(df.limit(0)).collect() == []


def test_clashing_columns_repeated_paths_ties_and_long_texts(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        ("a/x", mit), ("a/x", mit), ("b/x", "nothing"), ("b/x", mit), ("c/LICENSE", f"{mit}\n{apache}"), ("c/LICENCE", apache), ("c/y", "word " * 60_000),
        ("d/z", "word " * 60_000 + mit),
    ]
    names = ("dir", "dir_licence", "up", "row", "best", "k", "piece", "own_line", "origin", "similarity")
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(f"clash {c}") for c in names})
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) and all(r["dir"] == "clash dir" and r.dir_licence == "clash dir_licence" for r in got)
    found = {(r.path, r.text[:9]): (r.licence, r.origin, r.licence_dir) for r in got}
    assert found["a/x", mit[:9]] == found["b/x", "nothing"] == found["b/x", mit[:9]] == ("MIT", "own", None)
    # of two licences that are equally like, the first by name
    assert found["c/LICENSE", mit[:9]][0] == "Apache-2.0" and found["c/y", "word word"] == ("Apache-2.0", "inherited", "c")
    assert found["d/z", "word word"] == ("MIT", "own", None)


def test_every_template_is_its_own_best(spark):
    rows = [(f"d{k}/f{k}", f"x\n// {text.upper()}\nlong " * 3) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.path: r.licence for r in licenses.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"d{k}/f{k}": name for k, (name, _) in enumerate(licenses.TEMPLATES)}


def test_cosines_against_brute_force(spark):
    """Repeated known and unknown tokens, lines of one token, empty and very long lines."""
    rare, rows, unknown = licenses.weights()
    of = {}
    for name, token, weight in rows:
        of.setdefault(name, {})[token] = weight
    rng = random.Random(3)
    texts = ["", "\n\n", "mit", "isc " * 3000, "x " * 3000 + "released under the MIT license"]
    for k in range(300):
        words = re.findall(licenses.TOKEN, rng.choice(licenses.TEMPLATES)[1].lower())
        words = [w for w in words if rng.random() < 0.9] * rng.choice((1, 1, 2)) + rng.choices(["qq", "zz", "the", "KelvinK"], k=rng.randrange(6))
        rng.shuffle(words)
        texts.append(f"line {k}\n" + " ".join(words))

    def brute(text):
        found = []
        for number, line in enumerate(text.split("\n")):
            count = Counter(t.lower() for t in re.findall("[A-Za-z0-9]+", line))
            length = math.sqrt(sum((n * rare.get(t, unknown)) ** 2 for t, n in count.items()))
            for name, own in of.items():
                if len(own.keys() & count.keys()) > 1:
                    near = round(sum(n * rare[t] * own[t] for t, n in count.items() if t in own) / length, 6)
                    found += [(-near, name, number)] if near >= licenses.SIMILARITY else []
        return min(found, default=None)

    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = {int(r.path): (-r.similarity, r.licence, r.line) for r in licenses.own_licences(files).collect()}
    want = {k: best for k, t in enumerate(texts) if (best := brute(t))}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k][1:] == want[k][1:] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)


MIT_FILE = """MIT License

Copyright (c) 2019 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so.

The above copyright notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OF THE SOFTWARE."""
GPL_HEADER = """# tool.py - does a thing
# Copyright 2011 A. N. Author
#
# tool is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# tool is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main() { return 0; }"""
BSD_FILE = """Redistribution and use, with or without modification, are permitted provided that these conditions are met:
 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
   following disclaimer in the documentation and/or other materials provided with the distribution.
 * Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY EXAMPLE AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO
EVENT SHALL EXAMPLE BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_windows_and_tags(spark):
    """Texts that are no templates: edited licence files, headers over lines, sentences within lines, tags."""
    files = {
        "m/LICENSE": (MIT_FILE, "MIT"), "g/tool.py": (GPL_HEADER, "GPL-3.0"), "h/far.py": ("word " * 1100 + "\n" + GPL_HEADER, "GPL-3.0"),
        "z/main.c": (MPL_HEADER, "MPL-2.0"), "b/LICENSE": (BSD_FILE, "BSD-3-Clause"), "one/line.js": ("var a = 1; /* " + " ".join(MIT_FILE.split()) + " */ var b = 2;", "MIT"),
        "s/a.c": ("// SPDX-License-Identifier: MIT\nint a;", "MIT"), "s/b.c": ("/* SPDX-License-Identifier: gpl-2.0-or-later */", "GPL-2.0"),
        "s/c.c": ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "(MIT OR Apache-2.0)"), "s/d.c": ("# SPDX-License-Identifier: NONE", None),
        "i/readme": ("Copyright 2020 by some people of a far away place; released under the MIT license, see the other file for what that means to you", "MIT"),
        "n/prose": ("The software is useful, and any person may copy the notice without a fee.\n" * 30, None), "n/empty": ("", None),
    }
    df = spark.createDataFrame([(path, text) for path, (text, _) in files.items()], "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(df).collect()}
    assert {path: licence for path, (licence, origin) in got.items() if origin == "own"} == {path: want for path, (_, want) in files.items() if want}


@pytest.mark.parametrize("size", (3, 40, 700))
def test_windows_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(licenses, "STRETCH", size)
    texts = (("A", "alpha beta gamma delta alpha beta epsilon zeta"), ("B", "one two three alpha four five"), ("C", "beta gamma one"))
    rare, rows, unknown = licenses.weights([(k, t) for k, (_, t) in enumerate(texts)])
    rng = random.Random(size)
    files = [(str(k), "\n".join(" ".join(rng.choices([*rare, "qq", "zz"], k=rng.randrange(6))) for _ in range(rng.randrange(1, 9)))) for k in range(60)]

    def brute(text):
        words = [(w, number) for number, line in enumerate(text.split("\n")) for w in line.split()]
        found = []
        for k, (name, template) in enumerate(texts):
            own = {t: w for j, t, w in rows if j == k}
            for a in range(len(words)):  # texts this short step by one token
                count = Counter(w for w, _ in words[a : a + len(template.split())])
                near = round(sum(n * rare[t] * own[t] for t, n in count.items() if t in own) / math.sqrt(sum((n * rare.get(t, unknown)) ** 2 for t, n in count.items())), 6)
                if near >= licenses.SIMILARITY and len(own.keys() & count.keys()) > 1:
                    found.append((-near, name, words[a][1]))
        return min(found, default=None)

    got = {r.path: (-r.similarity, r.licence, r.line) for r in licenses.window_licences(spark.createDataFrame(files, "path string, text string"), texts).collect()}
    want = {path: best for path, text in files if (best := brute(text))}
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(got[k][1:] == want[k][1:] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)
