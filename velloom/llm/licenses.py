"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, utf8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU_NO = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name}
along with this program."""


def _gnu(short: str, name: str, version: str, dated: str) -> list[str]:
    head, rest = (t.format(name=name, version=version) for t in (_GNU, _GNU_NO))
    return [
        head, f"{head} {rest}", f"GNU {name.upper()} Version {version}, {dated}", f"GNU {name} v{version}", f"{short}v{version}",
        f"This work is licensed under the GNU {name}, version {version}.", f"SPDX-License-Identifier: {short}-{version}.0-only", f"SPDX-License-Identifier: {short}-{version}.0-or-later",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. " + f"GNU {name} Version {version}, {dated}",
    ]


def _cc(code: str, name: str) -> list[str]:
    return [f"Licensed under CC {code} 4.0.", f"CC {code} 4.0", f"SPDX-License-Identifier: CC-{code}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Creative Commons {name} 4.0 International Public License"]


#: Texts of licenses, headers, titles and statements by which works name their license.
TEMPLATES = {
    "MIT": [f"MIT License\n{_MIT}\n{_KEEP}\n{_AS_IS}", _MIT, f"{_MIT} {_KEEP}", "MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License 2.0", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": _gnu("GPL", "General Public License", "3", "29 June 2007"),
    "GPL-2.0": _gnu("GPL", "General Public License", "2", "June 1991"),
    "LGPL-3.0": _gnu("LGPL", "Lesser General Public License", "3", "29 June 2007") + ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": _gnu("AGPL", "Affero General Public License", "3", "19 November 2007") + ["This program is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": [f"{_BSD} {_BSD_AS_IS}", f"BSD 2-Clause License {_BSD} {_BSD_AS_IS}", _BSD, "BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAME} {_BSD_AS_IS}", f"BSD 3-Clause License {_BSD} {_BSD_NAME} {_BSD_AS_IS}", f"{_BSD} {_BSD_NAME}", "BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": [
        """ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License", "Licensed under the ISC license", "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
        can obtain one at https://mozilla.org/MPL/2.0/.""",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "MPL 2.0", "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
    ],
    "CC0-1.0": ["Released under CC0 1.0 Universal, dedicated to the public domain.", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution NonCommercial"),
}
LEAST = 0.75
#: Names that license files have.
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense)(?:[._-].*)?$"
TERM, LINE = re.compile(r"[^\W_]+"), re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
#: Passages whose license a task remembers, and the longest of them in characters.
MEMO, SHORT = 50_000, 300


def terms(text: str) -> list[str]:
    """Lower-case terms."""
    return TERM.findall(text.lower())


def vocabulary() -> list[str]:
    """The terms of the templates."""
    return sorted({t for some in TEMPLATES.values() for x in some for t in terms(x)})


class Templates:
    """Templates as unit vectors over their own terms, weighed by counts times inverse document frequency.

    ``df`` has the number of files of the corpus that hold a term, of ``files``. Terms that no template holds weigh what the median
    term of the templates weighs.
    """

    def __init__(self, df: dict[str, int], files: int):
        words = vocabulary()
        self.place = {t: i for i, t in enumerate(words)}
        self.idf = np.array([log((1 + files) / (1 + df.get(t, 0))) + 1 for t in words])
        self.other = float(np.median(self.idf))
        self.names = [n for n, some in TEMPLATES.items() for _ in some]
        self.matrix = np.zeros((len(words), len(self.names)))
        for k, x in enumerate(x for some in TEMPLATES.values() for x in some):
            for t, n in Counter(terms(x)).items():
                self.matrix[self.place[t], k] = n * self.idf[self.place[t]]
        self.matrix /= np.sqrt((self.matrix**2).sum(axis=0))

    def nearest(self, counts: Counter[str], least: float) -> tuple[float, str] | None:
        """(cosine, license) of the nearest template if it reaches ``least``; ties by name."""
        places, weights, foreign = [], [], 0
        for t, n in counts.items():
            at = self.place.get(t)
            if at is None:
                foreign += n * n
            else:
                places.append(at)
                weights.append(n)
        if not places:
            return None
        w = np.array(weights) * self.idf[places]
        own = float(w @ w)
        whole = own + foreign * self.other**2
        if own < (least - 1e-9) ** 2 * whole:  # what templates can't share is too much
            return None
        cosine = np.round(w @ self.matrix[places] / sqrt(whole), 9)
        top = float(cosine.max())
        return (top, min(n for n, c in zip(self.names, cosine) if c == top)) if top >= least else None


def judge(text: str, whole: bool, templates: Templates, least: float, memo: dict) -> tuple[str | None, float | None, int]:
    """(license, cosine, statements) of a text: the nearest of its passages, and how many reach ``least``.

    Passages are its lines, its blocks of lines (lines without terms part them; a header is one) and, with ``whole``, all of it.
    """
    found, blocks, block = [], [], []

    def look(line: str, counts: Counter[str] | None = None) -> None:
        key = line if len(line) <= SHORT and counts is None else None
        hit = memo.get(key, 0) if key else 0
        if hit == 0:
            hit = templates.nearest(counts or Counter(terms(line)), least)
            if key:
                if len(memo) > MEMO:
                    memo.clear()
                memo[key] = hit
        if hit:
            found.append(hit)

    for line in [*LINE.split(text), ""]:
        if TERM.search(line):
            look(line)
            block.append(line)
        elif block:
            if len(block) > 1:
                look("", Counter(terms("\n".join(block))))
            blocks.append(block)
            block = []
    if whole and len(blocks) > 1:
        look("", Counter(terms(text)))
    if not found:
        return None, None, 0
    cosine, name = min(found, key=lambda x: (-x[0], x[1]))
    return name, cosine, len(found)


def scan(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, path, license, origin, from_dir, cosine, n_statements) for every row of ``files``.

    Every line and every block of lines of every whole text, and every license file (``LICENSE``, ``COPYING`` and the like) as a whole,
    is compared with the templates, which are license bodies, standard headers, titles and statements. Document frequencies are those
    of all files, for the templates' terms. A file's license is that of its nearest passage (``origin`` own; ties by name). A file without
    one takes that of the license file in its own or the nearest ancestor directory (``origin`` inherited, the directory in
    ``from_dir``; of several license files in one the nearest to a template, then the first by name); otherwise origin is none.

    Texts are judged row by row and never shuffled; a memo of judged lines only saves time. Directories, not files, are joined with
    their ancestors, and only with those that have a license file. Null and empty texts state nothing; a null path belongs to no
    directory; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    pick = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    words = frozenset(vocabulary())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for x in utf8(batch.column(0)):
                held.update(words.intersection(terms(x.decode())))
        yield pa.record_batch([pa.array([None, *held], pa.string()), pa.array([n, *held.values()], pa.int64())], names=["term", "n"])

    counted = pick.select("text").mapInArrow(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the templates' terms
    df = {r["term"]: r["n"] for r in counted}
    templates = Templates(df, df.get(None, 0))
    id_type = pick.schema["doc_id"].dataType.simpleString()

    def judged_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            done = [judge(x.decode(), w, templates, least, memo) for x, w in zip(utf8(batch.column(2)), batch.column(3).to_pylist())]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "path", "license", "cosine", "n"])

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    whole = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)).alias("whole")
    judged = saved(pick.select("doc_id", "path", "text", whole).mapInArrow(judged_, f"doc_id {id_type}, path string, license string, cosine double, n long").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    holders = judged.where(name.rlike(LICENSE_FILE) & F.col("license").isNotNull()).groupBy(F.col("dir").alias("from_dir")).agg(F.min_by("license", F.struct(-F.col("cosine"), "path")).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = judged.where("dir is not null").select("dir").distinct().withColumn("from_dir", F.explode(F.array_distinct(above)))
    nearest = dirs.join(holders, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "given"), F.length("from_dir")).alias("g")).select("dir", "g.from_dir", "g.given")
    done = judged.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return done.select(
        "doc_id",
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"),
        "cosine",
        F.col("n").alias("n_statements"),
    )


#: Texts that become license files in ``tree``.
NAMED = r"(?i)licen[sc]e|spdx|\bcc0\b"


def tree(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: source/lang/number of 4096 documents/file.

    Of eight texts that speak of a license, by a hash of doc_id, one is a license file of its source, one of its source's language,
    one of its group; so files inherit over several levels, and the directories of a large source hold as large a share of all files.
    """
    id_ = F.col("doc_id").cast("string")
    level = F.when(F.coalesce(F.col("text").rlike(NAMED), F.lit(False)), F.conv(F.substring(F.md5(id_.cast("binary")), 1, 1), 16, 10).cast("int") % 8)
    group = F.floor(F.col("doc_id") / 4096).cast("string")
    file = F.when(level < 3, F.concat(F.lit("LICENSE-"), id_)).otherwise(F.concat(id_, F.lit(".txt")))
    folders = F.when(level == 0, F.concat_ws("/", "source")).when(level == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", group))
    return docs.select("doc_id", "text", F.concat_ws("/", folders, file).alias("path"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the license of every document, its own or inherited in the tree of documents."""
    return scan(tree(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle_sql() -> str:
    """The query in SQL: every passage's terms joined with every template's."""
    quoted = lambda x: "'" + " ".join(x.split()).replace("'", "''") + "'"
    values = ", ".join(f"({i}, '{name}', {quoted(x)})" for i, (name, x) in enumerate((n, x) for n, some in TEMPLATES.items() for x in some))
    term = r"'[\p{L}\p{N}]+'"
    return rf"""with tpl(id, license, line) as (values {values}),
    tt as (select id, license, term, count(*) m from (select id, license, unnest(regexp_extract_all(lower(line), {term})) term from tpl) group by all),
    f as (select row_number() over () rid, doc_id, coalesce(text, '') text, case when regexp_matches(coalesce(text, ''), '{NAMED}') then (instr('0123456789abcdef', substr(md5(doc_id::varchar), 1, 1)) - 1) % 8 end level, source, lang from documents),
    p as (select *, concat_ws('/', case when level = 0 then source when level = 1 then concat_ws('/', source, lang) else concat_ws('/', source, lang, (doc_id // 4096)::varchar) end, case when level < 3 then 'LICENSE-' || doc_id else doc_id || '.txt' end) path from f),
    file as (select *, regexp_replace(path, '/?[^/]*$', '') dir, coalesce(level < 3, false) is_license from p),
    lines as (select rid, unnest(range(len(l))) k, unnest(l) line from (select rid, regexp_split_to_array(text, '\r\n|[\n\x{{0B}}\x{{0C}}\r\x{{85}}\x{{2028}}\x{{2029}}]') l from file)),
    kept as (select *, k - row_number() over (partition by rid order by k) block from (select rid, k, regexp_extract_all(lower(line), {term}) terms from lines) where len(terms) > 0),
    tok as (select rid, k, block, unnest(terms) term from kept),
    df as (select term, count(distinct rid) n from tok group by term),
    vocab as (select term, ln((1 + (select count(*) from file)) / (1 + coalesce(n, 0))) + 1 idf from (select distinct term from tt) left join df using (term)),
    other as (select median(idf) o from vocab),
    blocks as (select rid, block, count(distinct k) n from kept group by all),
    passage as (select rid, 'l' || k pid, term, count(*) n from tok group by all
        union all select rid, 'b' || block, term, count(*) from tok join blocks using (rid, block) where blocks.n > 1 group by all
        union all select rid, 'w', term, count(*) from tok join file using (rid) where is_license and (select count(*) from blocks where blocks.rid = tok.rid) > 1 group by all),
    norms as (select rid, pid, sqrt(sum(case when idf is null then n * n * (select o * o from other) else n * n * idf * idf end)) w from passage left join vocab using (term) group by all),
    tnorm as (select id, sqrt(sum(m * m * idf * idf)) v from tt join vocab using (term) group by id),
    dots as (select rid, pid, id, license, sum(n * m * idf * idf) d from passage join tt using (term) join vocab using (term) group by all),
    best as (select rid, pid, arg_min(license, {{'c': -c, 'l': license}}) license, max(c) c from (select rid, pid, license, round(d / v / w, 9) c from dots join norms using (rid, pid) join tnorm using (id)) where c >= {LEAST} group by all),
    own as (select rid, arg_min(license, {{'c': -c, 'l': license}}) license, max(c) c, count(*) n from best group by rid),
    holders as (select dir from_dir, arg_min(own.license, {{'c': -c, 'p': path}}) given from file join own using (rid) where is_license group by dir),
    nearest as (select dir, arg_max(from_dir, length(from_dir)) from_dir, arg_max(given, length(from_dir)) given from (select dir, unnest(list_transform(range(len(string_split(dir, '/')) + 1), lambda k: array_to_string(string_split(dir, '/')[1:k], '/'))) from_dir from (select distinct dir from file)) join holders using (from_dir) group by dir)
    select doc_id, path, coalesce(own.license, given) license, case when own.license is not null then 'own' when given is not null then 'inherited' else 'none' end origin, case when own.license is null then from_dir end from_dir, own.c cosine, coalesce(own.n, 0) n_statements
    from file left join own using (rid) left join nearest using (dir)"""
