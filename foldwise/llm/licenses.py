"""Licences of files by sparse TF-IDF cosine to templates, and of their neighbours by nearest ancestor directory.

Every line of a whole text is a candidate header.  A line's tokens are weighted by their count and by how rare they
are among the templates; its cosine to a template must reach ``SIMILARITY``, with two tokens in common at least.  Lines that hold none of a template's
heaviest tokens can't reach it (the remaining tokens' weight bounds the cosine), so one pattern test spares many lines;
bounds from the counts of template tokens then spare nearly all others.  Cosines are sums within a line, so lines and
tokens are not shuffled; only the licences found are.

Besides, windows of a template's length slide over all tokens of a file, across lines: whole short licences, headers
of several lines and the beginnings of long licence files, where words of any English text count on neither side, and
the one-line statements within longer lines.  A file shorter than a template is one window.  SPDX tags are read as they stand.  Of all that is found the likest counts.
A file without a licence of its own takes that of the licence file in its nearest ancestor directory.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.licence_texts import TEXTS
from foldwise.session import materialise

SIMILARITY = 0.7
# Customary one-line statements of licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TOKEN = "[a-z0-9]+"
#: Tokens at which windows start in one piece of a file.
STRETCH = 512
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)"
# words of any English text, of no use in sparing texts
_COMMON = frozenset("the of to in by or and for is a an at on as be any all not use you this that with from other have without which such will their they your under into above provided been more".split())
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"


def weights(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """Rarity of each token, (licence, token, weight) with each template at length 1, and the rarity of unknown tokens.

    A licence with several statements has one name for each: a number is put before it.
    """
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    held = Counter(token for c in counts for token in c)
    rare = {token: math.log((1 + len(counts)) / (1 + n)) + 1 for token, n in held.items()}
    rows = []
    for (name, _), count in zip(templates, counts):
        length = math.sqrt(sum((n * rare[t]) ** 2 for t, n in count.items()))
        rows += [(name, t, n * rare[t] / length) for t, n in sorted(count.items())]
    return rare, rows, math.log(1 + len(counts)) + 1


def key_tokens(rows: list[tuple[str, str, float]], similarity: float) -> list[str]:
    """Tokens of which a line must hold at least one to reach the similarity with some template."""
    keys: set[str] = set()
    for name in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[2], r[1]))
        left = sum(w * w for _, t, w in own if t not in keys)
        for _, token, weight in own:
            if left < similarity**2 * 0.999:
                break
            if token not in keys:
                keys.add(token)
                left -= weight * weight
    return sorted(keys)


def own_licences(files: DataFrame, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """path, licence, similarity, line of the files with a line like a template: the likest, then the first by name and line.

    ``files`` has path and text; null paths and texts have no licence; a path stands for one text.
    """
    rare, rows, unknown = weights(templates)
    keys = f"(?i)(?<![a-z0-9])({'|'.join(key_tokens(rows, similarity))})(?![a-z0-9])"
    listed = sorted(rare)
    known = F.array(*(F.lit(t) for t in listed))
    words = F.transform(F.regexp_extract_all("words", F.lit("(?i)([a-z0-9]+)"), F.lit(1)), F.lower)

    def once(value: Column) -> Column:
        """Exploding a list of one keeps a value from being worked out again wherever it is used."""
        return F.explode(F.array(value))

    def total(factors: list[float], squared: bool = False) -> Column:
        """Sum over the listed tokens of count times factor, or of its square."""
        terms = F.zip_with("held", F.array(*(F.lit(float(f)) for f in factors)), lambda n, f: n * f * n * f if squared else n * f)
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    def in_common(tokens: set[str]) -> Column:
        return F.size(F.filter(F.zip_with("held", F.array(*(F.lit(t in tokens) for t in listed)), lambda n, own: (n > 0) & own), lambda x: x))

    # A line's length is at least what it would be if its other tokens all differed; with unit templates the cosine is
    # at most the length of the listed part over the whole length.
    room = 1 / similarity**2 - 1 + 1e-5
    lines = (
        files.where("path is not null and text is not null").select("path", "text").where(F.col("text").rlike(keys))
        .select("path", F.posexplode(F.split("text", r"\n")).alias("line", "words")).where(F.col("words").rlike(keys))
        .select("path", "line", once(words).alias("tokens")).select("path", "line", "tokens", once(F.filter("tokens", lambda t: F.array_contains(known, t))).alias("found"))
        .where((F.size("found") > 1) & (F.size("found") * F.size("found") * room >= F.size("tokens") - F.size("found")))
        .select("path", "line", "tokens", once(F.transform(known, lambda t: F.size(F.filter("found", lambda x: x == t)).cast("double"))).alias("held"))
        .select("path", "line", "tokens", "held", once(total([rare[t] for t in listed], squared=True)).alias("part"))
        .where(F.col("part") * room >= (F.size("tokens") - F.aggregate("held", F.lit(0.0), lambda s, n: s + n)) * unknown**2)
    )
    # equal other tokens stand together once sorted: a token that is the k-th of its run adds k*k - (k-1)*(k-1) = 2k - 1
    others = F.array_sort(F.filter("tokens", lambda t: ~F.array_contains(known, t)))
    runs = F.aggregate(
        others, F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("squares")),
        lambda s, t: F.struct(
            t.alias("last"), F.when(s.last == t, s.k + 1).otherwise(F.lit(1).cast("bigint")).alias("k"),
            (s.squares + F.when(s.last == t, 2 * s.k + 1).otherwise(F.lit(1).cast("bigint"))).alias("squares"),
        ),
        lambda s: s.squares,
    )
    measured = lines.select("path", "line", "held", once(F.sqrt(F.col("part") + runs * unknown**2)).alias("length"))
    of: dict[str, dict[str, float]] = {}
    for name, token, weight in rows:
        of.setdefault(name, {})[token] = weight
    cosines = F.array(*(
        F.struct(F.round(total([rare[t] * own.get(t, 0.0) for t in listed]) / F.col("length"), 6).alias("similarity"), F.lit(name).alias("licence"), in_common(set(own)).alias("common"))
        for name, own in sorted(of.items())
    ))
    near = measured.select("path", "line", F.explode(F.filter(cosines, lambda c: (c.common > 1) & (c.similarity >= similarity))).alias("near"))
    best = near.groupBy("path").agg(F.min(F.struct((-F.col("near.similarity")).alias("minus"), F.col("near.licence").alias("licence"), "line")).alias("best"))
    return best.select("path", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("similarity"), F.col("best.line").cast("bigint").alias("line"))


def fewest_tokens(own: dict[str, float], similarity: float) -> tuple[list[str], int]:
    """Tokens of a template and how many of them a window must hold at least to reach the similarity.

    Words of any English text are left out where the template can't be met by them alone.
    """
    need = similarity**2 * 0.999
    telling = {t: w for t, w in own.items() if t not in _COMMON}
    left = need - sum(w * w for t, w in own.items() if t in _COMMON)
    if left <= 0:
        telling, left = own, need
    mass = 0.0
    for k, weight in enumerate(sorted(telling.values(), reverse=True), 1):
        mass += weight * weight
        if mass >= left:
            return sorted(telling), k
    return sorted(telling), len(telling)


def needed_tokens(own: dict[str, float], similarity: float) -> list[str]:
    """The heaviest tokens of a template, of which a window must hold at least one: the others' weight is too small."""
    left, needed = sum(w * w for w in own.values()), []
    for token, weight in sorted(own.items(), key=lambda x: (-x[1], x[0])):
        if left < similarity**2 * 0.999:
            break
        needed.append(token)
        left -= weight * weight
    return sorted(needed)


def window_licences(files: DataFrame, templates=TEXTS, similarity: float = SIMILARITY, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """path, licence, similarity, line of the files with a window like a template: the likest, then the first by name and line.

    Tokens ``ignored`` count on neither side.  A window starts at any token and is as long as the template, or ends with the file.  Pieces of a file overlap by the
    longest template, so no window is cut.  Running sums over a piece bound the cosine of every window by two
    look-ups: a window is at least as long as if its tokens all differed.  Windows within the bound are measured.
    """
    told = [[t for t in re.findall(TOKEN, text.lower()) if t not in ignored] for _, text in templates]
    rare, rows, unknown = weights([(k, " ".join(tokens)) for k, tokens in enumerate(told)])
    of: list[dict[str, float]] = [{} for _ in templates]
    for k, token, weight in rows:
        of[k][token] = weight
    sizes = [len(tokens) for tokens in told]
    listed = sorted(rare)

    def packed(values, kind: str = "string") -> Column:
        """A constant array as one literal; thousands of literals would slow the planning."""
        return F.split(F.lit(" ".join(str(v) for v in values)), " ").cast(f"array<{kind}>")

    def likely(held: str) -> list[Column]:
        """A cosine is at most the length of that part of the template whose tokens are held at all."""
        return [
            F.arrays_overlap(packed(needed_tokens(own, similarity)), F.col(held)) & (F.size(F.array_intersect(packed(telling), F.col(held))) >= few)
            for own, (telling, few) in ((own, fewest_tokens(own, similarity)) for own in of)
        ]

    def once(value: Column) -> Column:
        return F.explode(F.array(value))

    def of_template(values: list) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("k") + 1)

    def running(values: Column) -> Column:
        """Sums of the values before each place and of all."""
        return F.aggregate(values, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def known(ids: str, values: Column, otherwise: float) -> Column:
        """The value of each token of the piece, by its place among the listed tokens that the piece holds."""
        return F.transform(ids, lambda i: F.when(i > 0, F.element_at(values, F.greatest(i, F.lit(1)))).otherwise(otherwise))

    tokens = F.flatten(F.transform(F.split("text", r"\n"), lambda words, line: F.transform(
        F.regexp_extract_all(words, F.lit("(?i)([a-z0-9]+)"), F.lit(1)), lambda t: F.struct(F.lower(t).alias("token"), line.alias("line")))))
    if ignored:
        tokens = F.filter(tokens, lambda x: ~F.array_contains(packed(sorted(ignored)), x.token))
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(STRETCH))
    pieces = (
        files.where("path is not null and text is not null")
        .select("path", "text", once(F.array_intersect(packed(listed), F.split(F.lower("text"), "[^a-z0-9]+"))).alias("held"))
        .where((F.size("held") > 1) & reduce(Column.__or__, likely("held")))
        .select("path", once(tokens).alias("tokens")).where(F.size("tokens") > 1)
        .select("path", F.explode(F.transform(starts, lambda a: F.slice("tokens", a + 1, F.lit(STRETCH + max(sizes))))).alias("piece"))
        .select("path", "piece", once(F.array_intersect(packed(listed), F.col("piece.token"))).alias("held")).where(F.size("held") > 1)
        .select("path", "piece", "held", once(F.filter(F.array(*(F.when(may, F.lit(k)) for k, may in enumerate(likely("held")))), lambda k: k.isNotNull())).alias("ks"))
        .where(F.size("ks") > 0)
    )
    rarity = packed((rare[t] for t in listed), "double")
    weight = F.element_at(F.array(*(packed((own.get(t, 0.0) for t in listed), "double") for own in of)), F.col("k") + 1)
    valued = (
        pieces.select(
            "path", "piece", "ks", once(F.transform("held", lambda t: F.array_position(packed(listed), t).cast("int"))).alias("places"),
            once(F.transform("piece", lambda x: F.array_position("held", x.token).cast("int"))).alias("ids"),
        )
        .select("path", "piece", "ks", "places", "ids", once(F.transform("places", lambda i: F.element_at(rarity, i))).alias("rares"))
        .select("path", "piece", "ks", "places", "ids", "rares", once(known("ids", F.col("rares"), unknown)).alias("rare"))
        .select("path", "piece", "ks", "places", "ids", "rare", once(running(F.transform("rare", lambda r: r * r))).alias("squares"))
        .select("path", "piece", "places", "ids", "rare", "squares", F.explode("ks").alias("k"))
        .select("path", "k", "piece", "ids", "rare", "squares", "places", once(weight).alias("all"))
        .select("path", "k", "piece", "ids", "rare", "squares", once(F.transform("places", lambda i: F.element_at("all", i))).alias("weights"))
        .select("path", "k", "piece", "rare", "squares", once(known("ids", F.col("weights"), 0.0)).alias("weight"), of_template(sizes).alias("size"))
        .select("path", "k", "piece", "rare", "squares", "weight", "size", once(running(F.zip_with("rare", "weight", lambda r, w: r * w))).alias("dots"))
    )

    def within(p: Column, sums: str) -> Column:
        return F.element_at(sums, F.least(p + F.col("size"), F.size("piece")) + 1) - F.element_at(sums, p + 1)

    def enough(p: Column) -> Column:
        return within(p, "dots") * (1 + 1e-9) + 1e-9 >= (similarity - 1e-6) * F.sqrt(F.greatest(within(p, "squares"), F.lit(0.0)))

    every = F.sequence(F.lit(0), F.least(F.size("piece"), F.lit(STRETCH)) - 1)
    row = F.transform("piece", lambda x, i: F.struct(x.token.alias("token"), x.line.alias("line"), F.get("rare", i).alias("rare"), F.get("weight", i).alias("weight")))
    chosen = valued.select("path", "k", "piece", "rare", "weight", "size", once(F.filter(every, enough)).alias("ps")).where(F.size("ps") > 0)
    windows = chosen.select("path", "k", "size", "ps", once(row).alias("piece")).select("path", "k", "size", "piece", F.explode("ps").alias("p"))
    # equal tokens stand together once sorted: the k-th of a run adds k*k - (k-1)*(k-1) = 2k - 1 squares
    cosine = F.aggregate(
        F.sort_array(F.slice("piece", F.col("p") + 1, F.col("size"))),
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("dot"), F.lit(0).alias("common")),
        lambda s, x: F.struct(
            x.token.alias("last"), F.when(s["last"] == x.token, s.run + 1).otherwise(F.lit(1)).alias("run"),
            (s.squares + F.when(s["last"] == x.token, 2 * s.run + 1).otherwise(F.lit(1)) * x.rare * x.rare).alias("squares"),
            (s["dot"] + x.rare * x.weight).alias("dot"),
            (s.common + F.when((s["last"] != x.token) & (x.weight > 0), F.lit(1)).otherwise(F.lit(0))).alias("common"),
        ),
        lambda s: F.when(s.common > 1, F.round(s["dot"] / F.sqrt(s.squares), 6)).otherwise(F.lit(0.0)),
    )
    found = windows.select(
        "path", of_template([name for name, _ in templates]).alias("licence"), once(cosine).alias("similarity"),
        F.element_at("piece", F.col("p") + 1)["line"].cast("bigint").alias("line"),
    )
    return likest(found.where(F.col("similarity") >= similarity))


def tagged_licences(files: DataFrame) -> DataFrame:
    """path, licence, similarity 1, line of the files with an SPDX tag; -only, -or-later and + are left off a lone identifier."""
    tag = F.regexp_replace(F.regexp_extract("words", SPDX, 1), r"[.]+$", "")
    lone = F.regexp_replace(F.regexp_replace(tag, r"^\(+([^()\s]+)\)+$", "$1"), r"(?i)^(\S+?)(-only|-or-later|\+)$", "$1")
    names = sorted({name for name, _ in (*TEMPLATES, *TEXTS)})
    named = F.coalesce(*(F.when(F.lower("licence") == name.lower(), name) for name in names), F.col("licence"))
    lines = (
        files.where("path is not null and text is not null").select("path", "text").where(F.col("text").rlike(SPDX))
        .select("path", F.posexplode(F.split("text", r"\n")).alias("line", "words")).where(F.col("words").rlike(SPDX))
    )
    found = lines.select("path", lone.alias("licence"), F.lit(1.0).alias("similarity"), F.col("line").cast("bigint").alias("line"))
    return likest(found.where(~F.upper("licence").isin("NONE", "NOASSERTION")).withColumn("licence", named))


def likest(found: DataFrame) -> DataFrame:
    """One row of each path: the likest licence, then the first by name and line."""
    best = found.groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "licence", "line")).alias("best"))
    return best.select("path", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("similarity"), F.col("best.line").alias("line"))


def stated_licences(files: DataFrame, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """path, licence, similarity, line of the files that state a licence by a line, by a window or by a tag."""
    found = own_licences(files, templates, similarity)
    for more in (window_licences(files, templates, similarity), window_licences(files, TEXTS, similarity, _COMMON), tagged_licences(files)):
        found = found.unionByName(more)
    return likest(found)


def directory(path: str | Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, licence_file: Column | None = None, templates=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """path, licence, similarity, origin, licence_dir of every row of ``files`` (path, text; further columns stay).

    origin is own, inherited or none.  ``licence_file`` tells which files license their directory (by name unless
    given; it may use the column own_line, the line of the file's own licence).  Of several the likest counts, then
    the first by licence name.  A null path has no licence; repeated rows get equal results; of different texts under one path the
    likest licence counts for all its rows.  Columns of ``files`` named like those returned, or own_line, are replaced; others
    may have any name.
    """
    kept = [c for c in files.columns if c not in ("licence", "similarity", "origin", "licence_dir", "own_line")]
    rows = files.select(F.struct(*kept).alias("row"), "path", directory("path").alias("dir"))
    own = materialise(stated_licences(files.select("path", "text"), templates, similarity).withColumnRenamed("line", "own_line"))
    flag = licence_file if licence_file is not None else F.col("path").rlike(LICENCE_FILE)
    licensed = own.where(flag).withColumn("dir", directory("path"))
    by_dir = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "licence")).alias("best"))
    by_dir = by_dir.select(F.col("dir").alias("up"), F.col("best.licence").alias("dir_licence"))
    # inheritance is settled once for each directory; an ancestor meets the directories below it, not their files
    dirs = rows.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(ups, F.array("dir")))).alias("up"))
    nearest = above.join(by_dir, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "dir_licence")).alias("best"))
    nearest = nearest.select("dir", F.col("best.up").alias("licence_dir"), F.col("best.dir_licence").alias("dir_licence"))
    joined = rows.join(own, "path", "left").join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    origin = F.when(mine, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.coalesce("licence", "dir_licence").alias("licence"), "similarity", origin.alias("origin"),
        F.when(~mine & F.col("dir_licence").isNotNull(), F.col("licence_dir")).alias("licence_dir"),
    )
