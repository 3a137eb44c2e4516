"""License scans: cosine of headers and licence files to templates, then inheritance by directory.

DataFrame functions only. A file's header blocks, its licence-like lines and, of licence files, paragraphs
and the whole are each one document; their terms are weighted by TF-IDF over all such documents. A file
without a match of its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Cosine from which a file is held to carry a template's licence.
LEAST = 0.5
#: Names of licence files (fixed values).
LICENCE_FILES = ("license", "licence", "copying", "license.txt", "license.md", "copying.txt", "unlicense", "notice")
#: Lines at the head of a file that are searched besides those that speak of licences anywhere.
MENTION = r"(?i)licen[sc]|copyright|spdx|public domain|permission is hereby|redistribution and use"
#: Lines that carry on a header: comments of the usual languages.
COMMENT = r"(?i)^\s*(?://|/\*|\*|#|--|;|%|<!--|\.\.\s|rem\s|dnl\s|'|\"\"\")"
#: Licence expressions behind SPDX tags; exceptions after "with" are no licences.
SPDX = r"(?i)spdx-license-identifier:([^\r\n]*)"

# Short texts by which each licence is known.
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2.0",
    "MIT": "released under the terms of the mit license permission is hereby granted free of charge to any person obtaining a copy of this software",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted bsd 3 clause license",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "LGPL-3.0": "this work is licensed under the gnu lesser general public license version 3",
    "AGPL-3.0": "this work is licensed under the gnu affero general public license version 3",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "CC-BY-4.0": "licensed under cc by 4.0 creative commons attribution 4.0 international license",
    "CC-BY-SA-4.0": "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international license",
    "CC-BY-NC-4.0": "licensed under cc by nc 4.0 creative commons attribution noncommercial 4.0 international license",
    "CC0-1.0": "cc0 1.0 universal public domain dedication",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Proprietary": "copyright all rights reserved",
}
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details you should have received a copy of the gnu {0}general public license along with this program if not see https www.gnu.org licenses"
# Whole headers and licence texts, and titles of texts too long for one.
HEADERS = {
    "Apache-2.0": ["licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2.0 january 2004 http www.apache.org licenses"],
    "MIT": ["mit license copyright c permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BSD-3-Clause": ["copyright c all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "GPL-3.0": [_GNU.format("", 3), "gnu general public license version 3 29 june 2007"],
    "GPL-2.0": [_GNU.format("", 2), "gnu general public license version 2 june 1991"],
    "LGPL-3.0": [_GNU.format("lesser ", 3), "gnu lesser general public license version 3 29 june 2007"],
    "AGPL-3.0": [_GNU.format("affero ", 3), "gnu affero general public license version 3 19 november 2007"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "mozilla public license version 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
}
#: A notice that goes with any licence: it counts only where no other licence is found.
WEAK = "Proprietary"
_GNU_TAIL = ("", "-only", "-or-later", "+")


def _spdx_ids(license: str) -> list[str]:
    return [license.lower() + x for x in (_GNU_TAIL if "GPL-" in license else ("",))]


def terms(text: Column) -> Column:
    """Words of letters, digits and points within numbers, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:\.[0-9]+)+|[a-z0-9]+)"), F.lit(1))


def _bags(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, term, tf: how often each term stands in a text (terms with spaces between)."""
    return texts.select(*keys, F.explode(F.split("text", " ")).alias("term")).where("term <> ''").groupBy(*keys, "term").agg(F.count("*").cast("double").alias("tf"))


def templates(spark: SparkSession) -> DataFrame:
    """template, license, text: sentences, headers and SPDX identifiers, an identifier being one term."""
    told = [(k, v) for k, v in TEMPLATES.items()] + [(k, v) for k, vs in HEADERS.items() for v in vs]
    texts = [F.struct(F.lit(i).alias("template"), F.lit(k).alias("license"), F.array_join(terms(F.lit(v)), " ").alias("text")) for i, (k, v) in enumerate(told)]
    ids = [(k, x) for k in TEMPLATES if k != WEAK for x in _spdx_ids(k)]
    texts += [F.struct(F.lit(len(told) + i).alias("template"), F.lit(k).alias("license"), F.lit("spdx:" + x).alias("text")) for i, (k, x) in enumerate(ids)]
    return spark.range(1).select(F.inline(F.array(*texts)))


def _runs(lines: Column, member) -> Column:
    """Texts of adjoining lines that are members."""
    return F.split(F.array_join(F.transform(lines, lambda x: F.when(member(x), F.translate(x, "\0", " ")).otherwise("\0")), "\n"), "\0")


def candidates(files: DataFrame) -> DataFrame:
    """path, rank, text: what is scored of each file, as terms with spaces between.

    rank 0: an SPDX identifier, one term; 1: a licence file as a whole, and blocks, which are runs of comment
    or licence-like lines that have one of the latter or, in a licence file, runs of lines that are not
    blank; 2: a licence-like line or, in a licence file, any line."""
    whole = F.lower(F.substring_index("path", "/", -1)).isin(*LICENCE_FILES)
    chosen = files.where("path is not null and text is not null").where(F.col("text").rlike(MENTION) | whole)
    cut = chosen.select("path", "text", whole.alias("whole"), F.split("text", "\r?\n").alias("lines"))
    of = lambda rank, texts: F.transform(texts, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("text")))
    some = lambda texts: F.filter(texts, lambda x: x.rlike(MENTION))
    blocks = F.when(F.col("whole"), _runs(F.col("lines"), lambda x: F.trim(x) != "")).otherwise(some(_runs(F.col("lines"), lambda x: x.rlike(MENTION) | x.rlike(COMMENT))))
    lines = F.when(F.col("whole"), F.col("lines")).otherwise(some(F.col("lines")))
    tags = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), lambda x: F.regexp_extract_all(F.regexp_replace(F.lower(x), r"\bwith\s+[a-z0-9.+-]+", ""), F.lit(r"([a-z0-9][a-z0-9.+-]*)"), F.lit(1))))
    tags = F.transform(tags, lambda x: F.concat(F.lit("spdx:"), x))
    units = cut.select("path", F.explode(F.concat(of(0, tags), of(1, F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>"))), of(1, blocks), of(2, lines))).alias("u"))
    return units.select("path", "u.rank", F.when(F.col("u.rank") == 0, F.col("u.text")).otherwise(F.array_join(terms(F.col("u.text")), " ")).alias("text")).where("text <> ''").groupBy("path", "text").agg(F.min("rank").alias("rank"))


def match(found: DataFrame) -> DataFrame:
    """path, license, score: of each path's texts of least rank that match, the best cosine to a template of
    TF-IDF vectors (ties: the longer template, then the name). WEAK is taken only where nothing else matches.
    The idf is over all distinct texts; texts that repeat are scored once and known by a 128-bit key."""
    spark = found.sparkSession
    found = written(found.withColumn("key", F.unhex(F.md5("text"))), "texts")
    bags = written(_bags(found.select("key", "text").dropDuplicates(["key"]), "key"), "bags")
    n = found.select("key").distinct().count()
    known = _bags(templates(spark), "template", "license")
    df = bags.groupBy("term").agg(F.count("*").alias("df"))
    # Terms of the templates are few and fixed; a term no text holds has df 0.
    want = known.select("term").distinct().join(df, "term", "left")
    idf = lambda c: F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce(c, F.lit(0)))) + 1
    model = known.join(want, "term").select("template", "license", "term", (F.col("tf") * idf(F.col("df"))).alias("w"))
    norm = model.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("n_terms"))
    model = model.join(norm, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("m"), "n_terms")
    model = F.broadcast(written(model, "model"))  # at most the templates' terms
    weighed = bags.join(df, "term").select("key", "term", (F.col("tf") * idf(F.col("df"))).alias("w"))
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = weighed.join(model, "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("m")).alias("dot"), F.max("n_terms").alias("n_terms"))
    score = dot.join(length, "key").select("key", "license", "n_terms", F.round(F.col("dot") / F.col("length"), 6).alias("score")).where(F.col("score") >= LEAST)
    best = score.groupBy("key").agg(F.min(F.struct((F.col("license") == WEAK).alias("weak"), (-F.col("score")).alias("neg"), (-F.col("n_terms")).alias("size"), "license")).alias("b"))
    best = written(best, "best")
    of_path = F.min(F.struct("b.weak", "rank", "b.neg", "b.size", "b.license")).alias("b")
    return found.select("path", "rank", "key").join(best, "key").groupBy("path").agg(of_path).select("path", F.col("b.license").alias("license"), (-F.col("b.neg")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, *carry: str) -> DataFrame:
    """path, license, score, origin, origin_path for each row of files (path, text).

    origin: own (a text of the file matches, see candidates()), inherited (from the licence file in the nearest directory at
    or above the file's; of several there the least path), or none. Null text has no candidates; a null path has
    no directory and no match: none. Rows that repeat a path share what any of them matches. Columns
    other than those of `carry`, which come back unchanged, are not read; a name of the result's own among them is
    a ValueError."""
    if clash := {"path", "license", "score", "origin", "origin_path"} & set(carry):
        raise ValueError(f"columns of the result cannot be carried: {sorted(clash)}")
    files = files.select("path", "text", F.struct(F.lit(1).alias("_"), *carry).alias("carried"))
    own = written(match(candidates(files)), "own")
    holds = own.where(F.lower(F.substring_index("path", "/", -1)).isin(*LICENCE_FILES))
    holds = holds.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "license", "score")).alias("held"))
    holds = written(holds, "holds")
    dirs = written(files.where("path is not null").select(directory(F.col("path")).alias("below")).distinct(), "dirs")
    parts = F.split("below", "/")
    above = dirs.select("below", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("below") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("a"))
    near = above.select("below", "a.depth", "a.dir").join(holds, "dir").groupBy("below").agg(F.max(F.struct("depth", "held")).alias("near"))
    near = written(near.select("below", F.col("near.held.license").alias("up"), F.col("near.held.score").alias("up_score"), F.col("near.held.path").alias("up_path")), "near")
    out = files.select("path", "carried", directory(F.col("path")).alias("below")).join(own, "path", "left").join(near, "below", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], "path", F.coalesce("license", "up").alias("license"), F.coalesce("score", "up_score").alias("score"), origin.alias("origin"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("up_path")).alias("origin_path"))
