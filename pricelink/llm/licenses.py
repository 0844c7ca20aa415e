"""License scans: sparse TF-IDF cosine against templates, then inheritance from the nearest licence file.

Templates are header statements and whole licence texts. What is held against them are a file's lines and sentences, each
two of these that stand together (a header that is wrapped), and the file as a whole. Each is a vector of word counts
times inverse document frequency over the templates (a word of no template weighs the most); the template with the
largest cosine of at least THRESHOLD gives its licence, on a tie the first name.

A file of which the whole, or parts with FILE_SHARE of its words, reach the threshold is a licence file of its directory;
one that reaches it in any other part has a header. A file without either takes the licence of the nearest directory above
it (its own first) that has a licence file; of several there, the best cosine, then the first name.

Before anything is shuffled, each part is bounded within its row: its product with a template is at most that with the
largest weight of each of its words in any template, and at most the length of its template words. A part that cannot
reach the threshold by both is dropped, and no other.
What is left is scored once for each distinct run of words, and directories are resolved once each, so a hot header or
directory adds no work. Templates are a list that the driver can hold.

Null texts have no words; null parts of a path count as empty. Repeated rows are given back as often as they come. Texts
are read whole; the arrays of a row grow with its text. An empty table gives an empty table.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import A_TO_Z, text_or_empty, written

THRESHOLD = 0.6
FILE_SHARE = 0.3
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
PART = r"\n|[.!?][ \t]+"
LINE, PAIR, WHOLE = 0, 1, 2
SLOTS = 1024
WORDS = "array<struct<h: long, idf: double, most: double>>"

#: Header statements of licences.
HEADERS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Distributed under the terms of the GPL v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("proprietary", "Copyright. All rights reserved."),
]

#: Licence texts, and the notices of licences whose texts are long.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
TEXTS = [
    ("MIT", f'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{BSD_CONDITIONS}\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_CONDITIONS}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{BSD_DISCLAIMER}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", GPL_NOTICE.format("3")),
    ("GPL-2.0", GPL_NOTICE.format("2")),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("statement")) for a, b in HEADERS + TEXTS])))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, A_TO_Z, A_TO_Z.lower()), F.lit(TOKEN), F.lit(0))


def weighted_templates(found: DataFrame, n: int) -> DataFrame:
    """(token, idf, license, statement, w): unit vectors of the n templates."""
    counts = found.select("license", "statement", F.explode(tokens(F.col("statement"))).alias("token")).groupBy("license", "statement", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    raw = counts.join(idf, "token").withColumn("x", F.col("tf") * F.col("idf"))
    size = raw.groupBy("license", "statement").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return raw.join(size, ["license", "statement"]).select("token", "idf", "license", "statement", (F.col("x") / F.col("size")).alias("w"))


def vocabulary(weights: DataFrame) -> Column:
    """The templates' words as a scalar: SLOTS arrays of (hash, idf, largest weight), by the hash."""
    words = weights.groupBy("token").agg(F.first("idf").alias("idf"), F.max("w").alias("most")).select(F.xxhash64("token").alias("h"), "idf", "most")
    held = words.groupBy(F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.collect_list(F.struct("h", "idf", "most")).alias("words"))
    every = weights.sparkSession.range(SLOTS).join(held, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("words", F.array().cast(WORDS)).alias("words"))
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "words"))).alias("all")).select(F.transform("all", lambda x: x["words"])).scalar()


def known_words(words: Column, slots: Column) -> Column:
    """(hash, idf, largest weight) of those words that occur in a template."""

    def found(x: Column) -> Column:
        return F.get(F.filter(F.get(slots, F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")), lambda e: e["h"] == F.xxhash64(x)), F.lit(0))

    return F.filter(F.transform(words, found), lambda e: e.isNotNull())


def possible(known: Column, strange: Column, unknown: float, threshold: float = THRESHOLD) -> Column:
    """May a part with these known words and `strange` others reach the threshold? A word that occurs n times adds the
    square of n times its idf to the squared length, which is the sum of the odd numbers up to n; the others add at
    least as much as if they were all distinct."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("length"), F.lit(0.0).alias("dot"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x["h"], acc["run"] + 1).otherwise(1)
        return F.struct(x["h"].alias("last"), run.alias("run"), (acc["length"] + (2 * run - 1) * x["idf"] * x["idf"]).alias("length"), (acc["dot"] + x["idf"] * x["most"]).alias("dot"))

    def reaches(acc: Column) -> Column:
        rest, least = strange * unknown**2, threshold**2
        return (acc["length"] * (1 - least) >= rest * least - 1e-6) & (acc["dot"] * acc["dot"] >= (acc["length"] + rest) * least - 1e-6)

    return (F.size(known) > 0) & F.aggregate(F.array_sort(known), start, step, reaches)


def parts(text: Column, slots: Column) -> Column:
    """(kind, words, known) of lines and sentences with words, of two that stand together, and of the whole."""
    found = F.filter(F.transform(F.split(text_or_empty(text), PART), tokens), lambda x: F.size(x) > 0)
    each = F.transform(found, lambda x: F.struct(x.alias("words"), known_words(x, slots).alias("known")))

    def part(kind: int, words: Column, known: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), words.alias("words"), known.alias("known"))

    def kinds(e: Column) -> Column:
        pairs = F.transform(F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), lambda x, i: part(PAIR, F.concat(F.get(e, i)["words"], x["words"]), F.concat(F.get(e, i)["known"], x["known"])))
        whole = F.filter(F.array(part(WHOLE, F.flatten(F.transform(e, lambda x: x["words"])), F.flatten(F.transform(e, lambda x: x["known"])))), lambda p: F.size(p["words"]) > 0)
        return F.concat(F.transform(e, lambda x: part(LINE, x["words"], x["known"])), pairs, whole)

    return F.get(F.transform(F.array(each), kinds), F.lit(0))


def as_unit(words: Column, slots: Column) -> Column:
    """What the cosine needs of a part: its template words, and for the others the sum of their squared counts."""
    known = lambda x: F.exists(F.get(slots, F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")), lambda e: e["h"] == F.xxhash64(x))
    others = F.array_sort(F.transform(F.filter(words, lambda x: ~known(x)), lambda x: F.xxhash64(x)))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, h: Column) -> Column:
        run = F.when(acc["last"] == h, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(h.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    return F.struct(F.array_join(F.filter(words, known), " ").alias("unit"), F.aggregate(others, start, step, lambda acc: acc["sum"]).alias("strange"))


def scored_parts(units: DataFrame, weights: DataFrame, unknown: float, threshold: float = THRESHOLD) -> DataFrame:
    """unit, strange, license, cosine for each distinct unit (see `as_unit`) that reaches the threshold."""
    distinct = written(units.select("unit", "strange").distinct().select(F.monotonically_increasing_id().alias("id"), "unit", "strange"), "license_units")
    template = F.struct("license", F.xxhash64("license", "statement").alias("number"), "w")
    by_token = F.broadcast(weights.groupBy("token").agg(F.first("idf").alias("idf"), F.collect_list(template).alias("in")))
    # dealt by unit once, all that follows stays in place
    counts = distinct.repartition("id").select("id", F.explode(F.split("unit", " ")).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    vector = counts.join(by_token, "token").withColumn("x", F.col("tf") * F.col("idf"))
    known = vector.groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    sizes = known.join(distinct, "id").select("id", F.sqrt(F.col("square") + F.col("strange") * F.lit(unknown**2)).alias("size"))
    each = vector.select("id", "x", F.inline("in"))
    dots = each.groupBy("id", "license", "number").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosines = dots.join(sizes, "id").withColumn("cosine", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("cosine") >= threshold)
    best = cosines.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return best.join(distinct, "id").select("unit", "strange", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))


def parents(folder: Column) -> Column:
    """(depth, directory) of a directory and all above it, the root ("") included."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


def inherited(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """folder, license, cosine, given_by: for each folder the licence of the nearest directory of `licensed` (folder,
    license, cosine) above it, itself included."""
    above = folders.select("folder").distinct().select("folder", F.inline(parents(F.col("folder"))))
    best = licensed.groupBy(F.col("folder").alias("given_by")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("b"))
    joined = above.join(best, F.col("above") == F.col("given_by"))
    nearest = joined.groupBy("folder").agg(F.max_by(F.struct("b.license", "b.minus", "given_by"), "depth").alias("n"))
    return nearest.select("folder", F.col("n.license").alias("license"), (-F.col("n.minus")).alias("cosine"), F.col("n.given_by").alias("given_by"))


def scan(files: DataFrame, found: DataFrame, key: str = "doc_id", folder: str = "folder", text: str = "text") -> DataFrame:
    """key, folder, license, cosine, how (header, file, inherited or none), given_by (a directory) and n_headers (lines and
    sentences that reach the threshold)."""
    n = found.count()
    weights, unknown = written(weighted_templates(found, n), "templates"), log(1.0 + n) + 1
    named = files.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(folder), F.lit("")).alias("folder"), F.col(text).alias("text")).withColumn("slots", vocabulary(weights))
    cut = named.select("row", "key", "folder", "slots", parts(F.col("text"), F.col("slots")).alias("every"))
    last = F.try_element_at("every", F.lit(-1))
    open_parts = F.transform(F.filter("every", lambda p: possible(p["known"], F.size(p["words"]) - F.size(p["known"]), unknown)), lambda p: F.struct(p["kind"].alias("kind"), F.size(p["words"]).alias("size"), as_unit(p["words"], F.col("slots")).alias("u")))
    rows = written(cut.select("row", "key", "folder", F.coalesce(F.size(last["words"]), F.lit(0)).alias("n_words"), open_parts.alias("parts")), "license_parts")
    each = rows.select("row", "n_words", F.inline("parts")).select("row", "n_words", "kind", "size", "u.unit", "u.strange")
    hits = each.join(scored_parts(each, weights, unknown), ["unit", "strange"])

    def words(kind: int) -> Column:
        return F.when(F.col("kind") == kind, F.col("size"))

    share = F.greatest(F.coalesce(F.sum(words(LINE)), F.lit(0)), F.coalesce(F.max(words(PAIR)), F.lit(0)))
    best = lambda p: F.min(F.when(p, F.struct((-F.col("cosine")).alias("minus"), F.col("license"))))
    whole, part = best(F.col("kind") == WHOLE), best(F.col("kind") != WHOLE)
    headed = hits.groupBy("row").agg(F.coalesce(whole, part).alias("best"), (whole.isNotNull() | (share >= FILE_SHARE * F.first("n_words"))).alias("is_file"), F.count_if(F.col("kind") == LINE).alias("n_headers"))
    headed = written(headed.select("row", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"), "is_file", "n_headers"), "license_headers")
    own = rows.select("row", "key", "folder").join(headed, "row", "left")
    near = inherited(rows, own.where("is_file").select("folder", "license", "cosine")).withColumnsRenamed({"license": "_license", "cosine": "_cosine"})
    how = F.when(F.col("is_file"), "file").when(F.col("is_file").isNotNull(), "header").when(F.col("_license").isNotNull(), "inherited").otherwise("none")
    bare = F.col("is_file").isNull()
    return own.join(near, "folder", "left").select(
        F.col("key").alias(key), "folder", F.when(bare, F.col("_license")).otherwise(F.col("license")).alias("license"), F.when(bare, F.col("_cosine")).otherwise(F.col("cosine")).alias("cosine"),
        how.alias("how"), F.when(bare, F.col("given_by")).alias("given_by"), F.coalesce("n_headers", F.lit(0).cast("long")).alias("n_headers"))


def document_folders(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, in it language, in it the thousand of the id; each seventh document lies in
    the folder of its source, two of seven in that of the language."""
    place = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7))
    top, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    deep = F.concat_ws("/", top, lang, F.floor(F.coalesce("doc_id", F.lit(0)) / 1000).cast("string"))
    return docs.select("doc_id", "text", F.when(place == 0, top).when(place <= 2, F.concat_ws("/", top, lang)).otherwise(deep).alias("folder"))
