"""License scan: normalised spans compared with license templates by the Dice coefficient over word bigrams.

A span is a line, or a paragraph of two lines or more. Two sets of sizes a and b reach a coefficient t only if
a * t / (2 - t) <= b <= a * (2 - t) / t, so a span meets only templates within these bounds; the bigrams that it
shares with them are counted by a join with the templates' bigrams. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, quoted, text_of

THRESHOLD = 0.8
#: Template bigrams up to which their table is broadcast.
BROADCAST_BIGRAMS = 200_000
#: Stands for blank lines in a normalised text.
MARK = "\x01"
WORD_BREAK = r"[^\p{L}\p{N}]+"

# Short public notices, opening paragraphs of public licenses, and (-notice, -text, -deed) whole notices
# as they are shipped: a block of comment lines has no blank line, so all of its paragraphs are one span.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-deed": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-notice": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), WORD_BREAK, " "))


def bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def key_words(templates: list[list[str]], ratio: float) -> list[str]:
    """Words of which every matching span holds one.

    A match lacks at most ``size - ceil(ratio * size)`` bigrams of its template, so of any one more that are
    picked it holds one; those with the longest words are picked, and of each its longest word stands for it.
    """
    keys = set()
    for own in templates:
        longest = sorted((max(b.split(" "), key=lambda w: (len(w), w)) for b in own), key=lambda w: (-len(w), w))
        keys.update(longest[: len(own) - math.ceil(len(own) * ratio - 1e-9) + 1])
    return sorted(keys)


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, span, license, dice) of each span and template that reach the threshold.

    Spans count from 0 in their kind. A template without two words matches nothing; a null or empty text has no
    span. Every line and paragraph of a text of any length is compared.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    known = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    known = known.withColumn("own", bigrams(F.split(normalised(F.col("template")), " "))).withColumn("size", F.size("own")).where("size > 0")
    ratio = threshold / (2 - threshold)
    index = known.select("license", "size", F.ceil(F.col("size") * ratio - 1e-9).alias("low"), F.floor(F.col("size") / ratio + 1e-9).alias("high"), F.explode("own").alias("bigram"))
    if sum(len(t.split()) for t in templates.values()) <= BROADCAST_BIGRAMS:
        index = F.broadcast(index)
    keys = key_words([r[0] for r in known.select("own").collect()], ratio)
    # the whole text is normalised once; line ends stay, and a mark stands for the blank lines between paragraphs
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), r"\n[\x20\x09-\x0D]*\n", MARK)
    clean = F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}\n{MARK}]+", " ")
    blocks = F.filter(F.split(F.col("clean"), MARK), lambda block: F.trim(block, F.lit("\n")).contains("\n"))
    spans = F.concat(
        F.transform(F.split(F.col("clean"), rf"[\n{MARK}]"), lambda line, i: F.struct(F.lit("line").alias("kind"), i.alias("span"), line.alias("body"))),
        F.transform(blocks, lambda block, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("span"), block.alias("body"))),
    )
    each = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), clean.alias("clean")).select("doc_id", "text_hash", F.explode(spans).alias("s"))
    words = each.select("doc_id", "text_hash", "s.kind", "s.span", F.split(F.trim(F.regexp_replace("s.body", r"[ \n]+", " ")), " ").alias("words"))
    words = words.where((F.size("words") > 1) & F.arrays_overlap("words", F.array(*map(F.lit, keys))))
    sized = words.withColumn("own", bigrams(F.col("words"))).withColumn("n", F.size("own"))
    shared = sized.select("doc_id", "text_hash", "kind", "span", "n", F.explode("own").alias("bigram")).join(index, "bigram")
    shared = shared.where(F.col("n").between(F.col("low"), F.col("high")))
    counted = shared.groupBy("doc_id", "text_hash", "kind", "span", "license", "n", "size").agg(F.count_distinct("bigram").alias("both"))
    return counted.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold).select("doc_id", "text_hash", "kind", "span", "license", "dice")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with license, dice, licenses and n_spans beside its own columns, every row included.

    license is the best match (largest coefficient, then name; null if none) and dice its coefficient, licenses
    all that match, sorted and joined by commas (empty if none), n_spans the matched spans. Repeated rows get
    equal results. Columns of ``docs`` with these names are replaced.
    """
    found = license_spans(docs, templates, threshold, id_col, text_col)
    best = F.max(F.struct("dice", F.struct((-F.col("rank")).alias("r"), "license").alias("which")))
    ranks = {name: i for i, name in enumerate(sorted(templates))}
    rank = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col("license")]
    per_row = (
        found.withColumn("rank", rank)
        .groupBy(F.col("doc_id").alias("id__"), F.col("text_hash").alias("hash__"))
        .agg(best.alias("best"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count_distinct("kind", "span").alias("n_spans"))
    )
    own, back = carried(docs, "license", "dice", "licenses", "n_spans")
    rows = docs.select(*own, F.xxhash64(text_of(text_col)).alias("own_hash__"), F.col(quoted(id_col)).alias("own_id__"))
    joined = rows.join(per_row, F.col("own_id__").eqNullSafe(F.col("id__")) & (F.col("own_hash__") == F.col("hash__")), "left")
    return joined.select(*back, F.col("best.which.license").alias("license"), F.col("best.dice").alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
