"""Licence notices in documents, by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import row_key

# Wording of licence notices as their stewards publish it, as (licence, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
                 "version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
            "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
            "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                     "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                     "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                     "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
                     "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                     "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
                     "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
)


def template_bigrams(text: str) -> list[str]:
    """Pairs of neighbouring words; words are runs of ASCII letters and digits, in lower case."""
    words = re.findall("[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _words(text_col: str) -> Column:
    """The same words of a column; splitting comes before lower-casing, so that only ASCII letters change."""
    parts = F.split(F.coalesce(as_col(text_col), F.lit("")), "[^A-Za-z0-9]+")
    return F.transform(F.filter(parts, lambda w: w != ""), F.lower)


def _candidates(templates, least_dice: float) -> Column:
    """The templates as a literal: number, licence, n bigrams, least common ones, distinct bigrams, times each occurs."""
    rows = []
    for k, (licence, text) in enumerate(templates):
        found = Counter(template_bigrams(text))
        n = sum(found.values())
        least = math.ceil(n * least_dice / (2 - least_dice) - 1e-9)
        cells = (F.array(*map(F.lit, found)).alias("bigrams"), F.array(*map(F.lit, found.values())).alias("times"))
        named = [F.lit(v).alias(c) for c, v in (("template", k), ("licence", licence), ("n", n), ("least", least))]
        rows.append(F.struct(*named, *cells))
    return F.array(*rows)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least_dice: float = 0.8) -> DataFrame:
    """Rows doc_id, licence, template, dice, first_word, n_windows: the best place of each template in each document.

    A template of n bigrams is compared with every stretch of a document that
    begins and ends with one of its bigrams; a better stretch would begin later
    or end earlier. Dice is twice the common bigrams, repeats counted, over the
    bigrams of both; ``least_dice`` (d) or more is a match. By size alone, only
    stretches of d / (2 - d) * n to (2 - d) / d * n bigrams can reach d, nor can a
    document that has fewer than the lower bound of the template's bigrams: its
    template is pruned before anything is compared. ``first_word`` is where the
    first of the best stretches starts, ``n_windows`` the number of places from
    which a stretch matches.

    From a start on, a bigram is common unless the template's number of it has
    been met since the start, that is, unless the same bigram so many
    occurrences before lies at the start or behind it. So the common bigrams of
    all stretches of a start are one running count over the known places ahead,
    as many as the upper bound at most, however long the document is.

    Missing and empty texts match nothing, so they have no row; rows alike in id
    and text are one document. Only bigrams of templates that remain leave a row,
    with their place, and meet the others of their document and template: a
    notice on a third of all documents is still a few rows for each.
    """
    d = least_dice
    vocabulary = sorted({b for _, text in templates for b in template_bigrams(text)})
    words = docs.select(as_col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), _words(text_col).alias("w"))
    size = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), size), lambda k: k > 0),
                        lambda k: F.struct((k - 1).alias("at"), F.concat_ws(" ", F.element_at("w", k), F.element_at("w", k + 1)).alias("bigram")))
    known = words.select("doc_id", "key", size.alias("size"), F.filter(pairs, lambda p: p["bigram"].isin(vocabulary)).alias("known"))

    def shared(t: Column) -> Column:
        return F.filter("known", lambda p: F.array_contains(t["bigrams"], p["bigram"]))

    candidates = F.filter(_candidates(templates, d), lambda t: (F.col("size") >= t["least"]) & (F.size(shared(t)) >= t["least"]))
    hits = (
        known.select("*", F.explode(candidates).alias("t")).select("doc_id", "key", "size", "t", F.explode(shared(F.col("t"))).alias("p"))
        .select("doc_id", "key", "size", "t.template", "t.licence", "t.n", "t.least", "p.at", "p.bigram",
                F.element_at("t.times", F.array_position("t.bigrams", F.col("p.bigram")).cast("int")).alias("times")))
    # One row for each place, also where a row repeats; all places of a document and template lie in one partition.
    hits = hits.distinct().repartition("doc_id", "key", "template")
    most = F.floor(F.col("n") * ((2 - d) / d) + 1e-9)
    longest = max((math.floor(len(template_bigrams(t)) * (2 - d) / d + 1e-9) for _, t in templates), default=1)
    repeats = max((times for _, t in templates for times in Counter(template_bigrams(t)).values()), default=1)
    alike = Window.partitionBy("doc_id", "key", "template", "bigram").orderBy("at").rowsBetween(-repeats, -1)
    earlier = F.collect_list("at").over(alike)
    hits = hits.withColumn("spent", F.coalesce(F.try_element_at(earlier, -F.col("times")), F.lit(-1)))
    ahead = Window.partitionBy("doc_id", "key", "template").orderBy("at").rangeBetween(0, max(longest - 1, 0))
    inside = F.collect_list(F.struct("at", "spent")).over(ahead)
    common = F.array_sort(F.transform(
        F.filter("inside", lambda h: (h["at"] < F.col("at") + most) & (h["spent"] < F.col("at"))), lambda h: h["at"]))
    dice = F.array_max(F.transform("common", lambda end, k: 2 * (k + 1) / (F.col("n") + end - F.col("at") + 1)))
    return (
        hits.withColumn("inside", inside).where(F.size("inside") >= F.col("least"))
        .withColumn("common", common).withColumn("dice", dice).where(F.col("dice") >= d - 1e-9)
        .groupBy("doc_id", "key", "licence", "template")
        .agg(F.max(F.struct(F.col("dice"), (-F.col("at")).alias("back"))).alias("best"), F.count("*").alias("n_windows"))
        .select("doc_id", "licence", "template", F.round("best.dice", 6).alias("dice"), (-F.col("best.back")).cast("long").alias("first_word"), "n_windows"))


def scan_licences_sql(templates=TEMPLATES, least_dice: float = 0.8) -> str:
    """The same over a table ``documents``, as SQL that joins all places of bigrams."""
    quoted = ", ".join(
        f"('{b}', {times}, {k}, '{licence}', {sum(found.values())})"
        for k, (licence, text) in enumerate(templates) if (found := Counter(template_bigrams(text))) for b, times in sorted(found.items()))
    return f"""
        WITH t(bigram, times, template, licence, n) AS (VALUES {quoted}),
        w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents),
        b AS (SELECT doc_id, len(w) - 1 AS size, unnest(range(0, len(w) - 1)) AS pos, w FROM w WHERE len(w) > 1),
        h AS (SELECT doc_id, size, pos, lower(w[pos + 1]) || ' ' || lower(w[pos + 2]) AS bigram FROM b),
        p AS (SELECT h.doc_id, h.size, h.pos, t.* FROM h JOIN t USING (bigram)),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template, bigram ORDER BY pos) AS k FROM p),
        q AS (SELECT k.*, coalesce(e.pos, -1) AS spent FROM k LEFT JOIN k e
              ON k.doc_id = e.doc_id AND k.template = e.template AND k.bigram = e.bigram AND e.k = k.k - k.times),
        c AS (SELECT a.doc_id, a.template, a.licence, a.n, a.pos, z.pos AS last,
                     row_number() OVER (PARTITION BY a.doc_id, a.template, a.pos ORDER BY z.pos) AS common
              FROM q a JOIN q z ON a.doc_id = z.doc_id AND a.template = z.template AND z.pos >= a.pos
                               AND z.pos - a.pos + 1 <= a.n * CAST({(2 - least_dice) / least_dice!r} AS DOUBLE) + 1e-9 AND z.spent < a.pos),
        s AS (SELECT doc_id, template, licence, pos, max(CAST(2 * common AS DOUBLE) / (n + last - pos + 1)) AS dice FROM c
              GROUP BY doc_id, template, licence, pos HAVING max(CAST(2 * common AS DOUBLE) / (n + last - pos + 1)) >= {least_dice} - 1e-9)
        SELECT doc_id, licence, template, round(max(dice), 6) AS dice,
               CAST(min(pos) FILTER (WHERE dice = best) AS BIGINT) AS first_word, count(*) AS n_windows
        FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, template) AS best FROM s) x GROUP BY doc_id, licence, template
    """
