"""Licence scan in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

A file is cut into blocks: the whole file, its paragraphs (runs of adjoining lines) and its lines; white space, comment
marks and punctuation are no words.  A template's terms, rarest first, give its anchors: terms whose removal would leave
too little weight to reach the threshold, so a block without an anchor can't match.  Of the blocks with an anchor, those
go on whose terms hold enough of a template's length; both bounds are exact.  What is left becomes sparse vectors and is
compared.  Document frequencies count every file of the table.

A file's own licence is that of its best block.  A file most of whose words are one licence block is a licence file: it
speaks for its directory.  Files without a licence of their own take the one of the nearest ancestor directory that has
one.  Directories are resolved once each, before files are joined to them.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
#: Notices, standard headers and short licences in full, as commonly published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("MIT", f"MIT License {_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("MIT", _GRANT),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", _GNU.format(":", "General Public License", ",", "3")),
    ("GPL-2.0", _GNU.format(";", "General Public License", ";", "2")),
    ("LGPL-2.1", _GNU.format(";", "Lesser General Public License", ";", "2.1")),
    ("AGPL-3.0", _GNU.format(":", "Affero General Public License", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
THRESHOLD = 0.75
#: Share of a file's words in a licence block from which it is a licence file.
FILE_SHARE = 0.5
WORD = "[a-z0-9]+"
#: What lies between paragraphs.
BLANK = r"\n[ \t\r]*\n[ \t\r\n]*"


def _words(column):
    """Lower-case A-Z only, so that every engine cuts the same words."""
    return F.regexp_extract_all(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), 0)


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """(template_id, license, term, tf) of the templates."""
    t = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "template_id int, license string, body string")
    return t.select("template_id", "license", F.explode(_words(F.col("body"))).alias("term")).groupBy("template_id", "license", "term").agg(F.count("*").alias("tf"))


def texts_of(folder: str, most_bytes: int = 4_000_000) -> list[tuple[str, str]]:
    """Templates from a folder of whole licence texts, a file each, named like the licence: to be added to ``TEMPLATES`` and given to ``scan`` as ``rows``.

    Links are followed; files alike in text are one.  Templates are broadcast, so more than ``most_bytes`` are an error.
    """
    seen, rows = set(), []
    for path in sorted(Path(folder).iterdir()):
        body = path.read_text("utf-8", "replace") if path.is_file() else ""
        if body.strip() and body not in seen:
            seen.add(body)
            rows.append((path.name, body))
    if sum(len(b.encode()) for _, b in rows) > most_bytes:
        raise ValueError("the templates are too large to be sent to every task")
    return rows


def weighted(files: DataFrame, rows=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Staged, a row per template term: (template_id, license, term, idf, idf_max, w, norm2, anchor).  Document frequencies are those of all ``files``."""
    t = templates(files.sparkSession, rows)
    vocabulary = sorted({w for _, body in rows for w in "".join(c if c.isascii() and c.isalnum() else " " for c in body.lower()).split()})
    here = F.array_intersect(_words(F.coalesce("text", F.lit(""))), F.array(*[F.lit(w) for w in vocabulary]))
    # one pass: a file counts once for each of its terms and once for itself, under the empty term
    counts = stage(files.select(F.explode(F.concat(F.array(F.lit("")), here)).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n = counts.agg(F.coalesce(F.max(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("n"))
    rare = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    # all tables here are bounded by the templates
    w = t.join(F.broadcast(counts), "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", rare).withColumn("idf_max", F.log(F.col("n") + 1) + 1).withColumn("w", F.col("tf") * F.col("idf"))
    w = w.withColumn("norm2", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template_id")))
    before = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template_id").orderBy(F.desc("idf"), "term")) - F.col("w") * F.col("w")
    anchor = F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") - before) / F.col("norm2")) >= threshold - 1e-9
    return stage(w.withColumn("anchor", anchor).select("template_id", "license", "term", "idf", "idf_max", "w", "norm2", "anchor"), "weights")


def blocks(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, text, file_words) cut into (doc_id, file_words, kind, block, body): the whole file (0), its paragraphs (1) and its lines (2).

    A file of one paragraph and a paragraph of one line are not repeated.
    """
    paragraphs = F.split("text", BLANK)
    part = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("block"), x.alias("body"))
    whole = F.filter(F.transform(F.array("text"), part(0)), lambda _: F.size(paragraphs) > 1)
    several = F.filter(F.transform(paragraphs, part(1)), lambda x: F.instr(x["body"], "\n") > 0)
    each = F.concat(whole, several, F.transform(F.split("text", "\n"), part(2)))
    return files.select("doc_id", "file_words", F.explode(each).alias("b")).select("doc_id", "file_words", "b.*")


def matches(files: DataFrame, rows=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``files`` (doc_id, text) -> per file with a match: (doc_id, license, score, covers), its best block.

    A block that holds ``file_share`` of the file's words (``covers``) comes before others, then the higher score, the
    larger kind of block, the first, and the first template.
    """
    weights = weighted(files, rows, threshold)
    terms = weights.groupBy().agg(F.collect_set(F.when(F.col("anchor"), F.col("term"))).alias("anchors"), F.collect_set("term").alias("known"), F.max("idf_max").alias("idf_max")).first()
    anchors, known = (F.array(*[F.lit(x) for x in sorted(terms[c] or [])]).cast("array<string>") for c in ("anchors", "known"))  # bounded by the templates' terms
    key = ["doc_id", "kind", "block", "body_id"]
    touched = files.withColumn("words", _words(F.col("text"))).where(F.arrays_overlap("words", anchors)).select("doc_id", "text", F.size("words").cast("long").alias("file_words"))
    cut = blocks(touched).withColumn("words", _words(F.col("body"))).where(F.arrays_overlap("words", anchors))
    candidates = stage(cut.select("doc_id", "file_words", "kind", "block", F.xxhash64("words").alias("body_id"), "words"), "blocks")
    # exact bound: the cosine is at most the share of the template's length that lies in terms of the block
    mass = candidates.select(*key, F.explode(F.array_intersect("words", known)).alias("term")).join(F.broadcast(weights.select("template_id", "term", "w", "norm2")), "term")
    able = mass.groupBy(*key, "template_id", "norm2").agg(F.sum(F.col("w") * F.col("w")).alias("mass")).where(F.col("mass") >= threshold * threshold * F.col("norm2") * (1 - 1e-9))
    able = able.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = F.col("body_id") == F.col("_body_id")
    for c in key[:3]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = candidates.join(able, same, "left_semi")
    one = [*key, "file_words", "block_words"]
    counted = kept.select(*key, "file_words", F.size("words").cast("long").alias("block_words"), F.explode("words").alias("term")).groupBy(*one, "term").agg(F.count("*").alias("btf"))
    idf = weights.select("term", "idf").distinct()
    vectors = counted.join(F.broadcast(idf), "term", "left").withColumn("bw", F.col("btf") * F.coalesce("idf", F.lit(terms["idf_max"] or 0.0)))
    # one pass over a block's terms: its length, and its products with every template, as an entry a template
    entries = vectors.join(F.broadcast(weights.select("term", F.struct("template_id", "license", "norm2", "w").alias("t")).groupBy("term").agg(F.collect_list("t").alias("ts"))), "term", "left")
    norms = Window.partitionBy(*one)
    dots = entries.withColumn("bnorm2", F.sum(F.col("bw") * F.col("bw")).over(norms)).select(*one, "bnorm2", "bw", F.explode("ts").alias("t")).groupBy(*one, "bnorm2", "t.template_id", "t.license", "t.norm2").agg(F.sum(F.col("bw") * F.col("t.w")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("norm2") * F.col("bnorm2")), 6)).where(F.col("score") >= threshold).withColumn("covers", F.col("block_words") >= F.col("file_words") * file_share)
    best = F.min_by(F.struct("license", "score", "covers"), F.struct(~F.col("covers"), -F.col("score"), F.col("kind"), F.col("block"), F.col("template_id")))
    return scored.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.license", "b.score", "b.covers")


def scan(files: DataFrame, path: str = "path", rows=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``files`` (doc_id, text, and the column ``path``: directories joined by ``/``) -> per row: doc_id, path, own_license, score, is_license_file, license, inherited_from.

    Null and empty texts have no licence of their own; a null path has no directory and inherits nothing; blocks of
    equal score: see ``matches``; two licence files in a directory: the higher score, then the smaller doc_id.  Rows that
    repeat a doc_id, null ones too, are one file for its own licence.  An empty table gives no rows.
    """
    base = files.select(F.col("doc_id"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    found = matches(base.select("doc_id", "text"), rows, threshold, file_share).withColumnRenamed("doc_id", "found_id")
    sized = base.select("doc_id", "path", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit("")).alias("dir"))
    own = stage(sized.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").withColumn("is_license_file", F.coalesce("covers", F.lit(False))).drop("found_id", "covers"), "licences")
    declared = own.where("is_license_file and dir is not null").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("doc_id"))).alias("dir_license")).withColumnRenamed("dir", "ancestor")
    # a/b/c -> a/b/c, a/b, a and the root, with depth
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    dirs = sized.select("dir").where("dir is not null").distinct().select("dir", F.posexplode(up).alias("depth", "ancestor"))
    nearest = dirs.join(declared, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license"), "depth").alias("a")).select("dir", F.col("a.ancestor").alias("ancestor"), F.col("a.dir_license").alias("dir_license"))
    out = own.join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path", F.col("license").alias("own_license"), "score", "is_license_file",
        F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNull() & F.col("dir_license").isNotNull(), F.col("ancestor")).alias("inherited_from"),
    )
