"""Licence scans by TF-IDF cosine to templates, and inheritance from directories; DataFrame functions only.

Passages of a file are its paragraphs, lines and sentences that name a licence; those of a licence file are its whole text as
well. Each distinct passage is a sparse TF-IDF vector; its cosine to every template's vector, of headers and of whole licence
files, gives the licence it states, from ``LEAST`` on. Document frequencies are counted over all distinct passages and
templates. A file states the licence of its best passage; a file that states none has that of the licence file in its nearest
ancestor directory, its own directory first. Ancestors are looked up once for each directory, not for each file.

Null and empty texts state none but may inherit. Files without a path inherit nothing. Of equally good licences the first in
alphabetical order counts, and likewise of licence files in one directory. Repeated rows are judged alike; whole texts are
read, however long. An empty table gives an empty one. Other columns pass through, those of the result's names are replaced;
helper columns begin with ``_qm_``, names that a table must not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.session import bounded, checkpointed, table

# Public licence texts and the notices that they ask for.
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_START = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/."""
UNLICENSE_BODY = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""


def _gnu(kind: str, version: str) -> list[str]:
    name = f"{kind}General Public License"
    return [
        GNU_NOTICE.format(name=name, version=version),
        GNU_NOTICE.format(name=name, version=version).split("\n")[0],
        f"This work is licensed under the GNU {name}, version {version}.",
        f"Distributed under the terms of the GNU {name} v{version}.",
        f"GNU {name.upper()} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ]


def _commons(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"Creative Commons {long} 4.0 International Public License ({short})"]


#: Licence -> texts that state it: notices, headers and licence files or their beginnings.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", MIT_BODY, MIT_BODY.split("\n")[0]],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", APACHE_HEADER, APACHE_HEADER.split(" You may")[0], APACHE_START],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", BSD_TWO + "\n" + BSD_END],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "\n".join([BSD_TWO, BSD_THIRD, BSD_END]), "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", BSD_TWO.split("\n")[0]],
    "ISC": ["Licensed under the ISC License.", ISC_BODY],
    "MPL-2.0": ["Licensed under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["Released under the Unlicense.", UNLICENSE_BODY, UNLICENSE_BODY.split("\n")[0]],
    "Zlib": ["Licensed under the zlib License.", ZLIB_BODY],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal public domain dedication."],
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "Proprietary": ["All rights reserved. Copyright. Do not distribute.", "All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
for _name, _texts in TEMPLATES.items():
    if _name != "Proprietary":
        _texts.append(f"SPDX-License-Identifier: {_name}")
HINT = r"(?i)licen[cs]e|copyright|all rights reserved|proprietary|permission (?:is|to)|redistribut|spdx|creative commons|public domain|\bCC ?(?:BY|0)|free software"
FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
TOKEN = r"[\p{L}\p{N}]+"
#: What stands between paragraphs: a line without words, in a comment or not.
BLANK = r"\n[^\p{L}\p{N}\n]*(?=\n)"
LEAST = 0.6
#: Directories with a licence file that are broadcast at most.
DIRECTORIES = 200_000


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _vectors(texts: DataFrame, key: list[str], idf: DataFrame) -> DataFrame:
    """(key, token, w) with vectors of length one."""
    tf = texts.select(*key, F.explode(_tokens(F.col("passage"))).alias("token")).groupBy(*key, "token").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(*key, "token", (F.col("w") / F.col("norm")).alias("w"))


def stated(passages: DataFrame) -> DataFrame:
    """(passage, license, score) of the distinct passages that state a licence."""
    spark = passages.sparkSession
    texts = spark.createDataFrame([(name, k, text) for name, some in TEMPLATES.items() for k, text in enumerate(some)], "license string, k int, passage string")
    passages = checkpointed(passages.select("passage").distinct().withColumn("p", F.xxhash64("passage")))
    every = passages.select("passage").unionAll(texts.select("passage")).distinct()
    n = every.count()
    idf = every.select(F.explode(F.array_distinct(_tokens(F.col("passage")))).alias("token")).groupBy("token").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    idf = checkpointed(idf)
    template = _vectors(texts, ["license", "k"], idf).withColumnRenamed("w", "v")
    products = _vectors(passages.select("passage", "p"), ["p"], idf).join(F.broadcast(template), "token")  # as many rows as TEMPLATES has words
    scores = products.groupBy("p", "license", "k").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("score")).where(F.col("score") >= LEAST)
    best = scores.groupBy("p").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    return passages.join(best, "p").select("passage", "best.license", (-F.col("best.score")).alias("score"))


def passages_of(text: Column, is_file: Column) -> Column:
    """The passages of a text: what names a licence among its paragraphs, lines and sentences; a licence file's whole text."""
    named = lambda parts: F.filter(parts, lambda x: x.rlike(HINT))
    lines = named(F.split(text, "\n"))
    sentences = F.flatten(F.transform(lines, lambda x: named(F.split(x, r"(?<=[.!?;])\s+"))))
    # A hint anywhere is looked for first, so that most texts are never split.
    found = F.when(text.rlike(HINT), F.concat(named(F.split(text, BLANK)), lines, sentences)).otherwise(F.array().cast("array<string>"))
    whole = F.when(is_file & text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.concat(found, whole)), F.array().cast("array<string>"))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` without the text, with own_license, own_score, license and license_from: ``own`` or the directory."""
    names = {"own_license", "own_score", "license", "license_from"}
    columns = [F.col(f"`{c}`") for c in files.columns if c not in names | {text}]
    at = F.col(f"`{path}`")
    is_file = F.coalesce(at.rlike(FILE), F.lit(False))
    directory = F.regexp_replace(F.concat(F.lit("/"), at), "/[^/]*$", "")
    rows = files.select(*columns, passages_of(F.col(f"`{text}`"), is_file).alias("_qm_passages"), F.uuid().alias("_qm_id"), is_file.alias("_qm_file"), directory.alias("_qm_dir"))
    rows = checkpointed(rows)  # the ids are written out with the rows and so stay what they are
    each = rows.select("_qm_id", F.explode("_qm_passages").alias("passage"))
    own = each.join(stated(each), "passage").groupBy("_qm_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("_qm_own"))
    told = checkpointed(rows.drop("_qm_passages").join(own, "_qm_id", "left").drop("_qm_id"))

    licensed = checkpointed(told.where("_qm_file and _qm_own is not null").groupBy(F.col("_qm_dir").alias("dir")).agg(F.min("_qm_own.license").alias("license")))
    parts = F.split("_qm_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    needy = told.where("_qm_own is null and _qm_dir is not null").select("_qm_dir").distinct().select("_qm_dir", F.posexplode(ancestors).alias("depth", "dir"))
    nearest = checkpointed(needy.join(bounded(licensed, DIRECTORIES), "dir").groupBy("_qm_dir").agg(F.max(F.struct("depth", "dir", "license")).alias("_qm_near")))
    out = told.join(bounded(nearest, DIRECTORIES), "_qm_dir", "left")
    return out.select(
        *columns,
        F.col("_qm_own.license").alias("own_license"),
        (-F.col("_qm_own.score")).alias("own_score"),
        F.coalesce("_qm_own.license", "_qm_near.license").alias("license"),
        F.when(F.col("_qm_own").isNotNull(), "own").otherwise(F.col("_qm_near.dir")).alias("license_from"),
    )


def paths(docs: DataFrame) -> DataFrame:
    """``docs`` with the path that stands in for the one which the table lacks.

    A source is a root with a directory for each thousand ids and one in that for each hundred, which holds the documents as
    files. A document that names a licence is a notice of its thousand, from which the other documents there inherit.
    """
    id, notice = F.col("doc_id"), F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(id / 1000).cast("string"))
    name = F.when(notice, F.concat(F.lit("NOTICE-"), id.cast("string"))).otherwise(F.concat(F.floor(id / 100).cast("string"), F.lit("/"), id.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat(folder, F.lit("/"), name))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited by the paths of ``paths``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scan(paths(docs)).select("doc_id", "path", "own_license", "own_score", "license", "license_from")
