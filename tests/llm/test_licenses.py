import math
import re
from collections import Counter

from velloom.llm import licenses

DDL = "doc_id long, text string, path string, lang string, source string, line string, license string, n long, dir string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
MIT_BODY = licenses.TEMPLATES["MIT"][0].split("\n", 1)[1]
TERMS = lambda s: re.findall(r"[^\W_]+", s.lower())


def cosines(texts):
    """The cosine of a passage to every template, by dictionaries."""
    templates = [(n, Counter(TERMS(t))) for n, ts in licenses.TEMPLATES.items() for t in ts]
    words = sorted({t for _, c in templates for t in c})
    df = Counter(t for x in texts for t in set(TERMS(x or "")))
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in words}
    ordered = sorted(idf.values())
    other = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vec = lambda c: {t: n * idf.get(t, other) for t, n in c.items()}

    def best(passage):
        v = vec(Counter(TERMS(passage)))
        found = [(-round(sum(x * u.get(t, 0) for t, x in v.items()) / norm(u) / norm(v), 9), n) for n, u in ((n, vec(c)) for n, c in templates)] if v else []
        return min((x for x in found if -x[0] >= licenses.LEAST), default=None)

    return best


def brute(rows):
    best, own = cosines([r[1] for r in rows]), []
    for _, text, path in rows:
        lines = re.split("\r\n|[\n\x0b\x0c\r\x85  ]", text or "")
        passages, block = [x for x in lines if TERMS(x)], []
        blocks = 0
        for x in [*lines, ""]:
            if TERMS(x):
                block.append(x)
            elif block:
                blocks += 1
                if len(block) > 1:
                    passages.append(" ".join(block))
                block = []
        if blocks > 1 and re.search(licenses.LICENSE_FILE, (path or "").rsplit("/", 1)[-1]):
            passages.append(text)
        own.append(min((b for b in map(best, passages) if b), default=None))
    holders = {}
    for (_, _, p), b in zip(rows, own):
        if p and b and re.search(licenses.LICENSE_FILE, p.rsplit("/", 1)[-1]):
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            holders[d] = min(holders.get(d, (9, "", "")), (b[0], p, b[1]))
    out = []
    for (i, _, p), b in zip(rows, own):
        if b:
            out.append((i, b[1], "own", None))
            continue
        d = None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
        while d is not None and d not in holders:
            d = None if d == "" else d.rsplit("/", 1)[0] if "/" in d else ""
        out.append((i, holders[d][2], "inherited", d) if d is not None else (i, None, "none", None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [
        (1, f"words\n{MIT}", "LICENSE"), (2, "a", "x.txt"), (3, f"b\n  {GPL}  \nc", "a/COPYING"), (4, "c", "a/b/c/d.txt"), (5, "Licensed under CC BY-NC 4.0.", "a/b/e.txt"),
        (6, None, "a/b/f.txt"), (7, "", None), (8, "the license of this door is blue", "ab/x"), (9, f"{MIT}\r\n{GPL}", "a/b/LICENSE.txt"), (10, "word " * 50_000 + "\n" + GPL, "z/LICENSEE/y.py"),
        (11, "licensed under apache license version 2.0", "q/license"), (12, "z", "q/r/s"), (13, "Released under MIT", "q/t"), (2, "a", "x.txt"), (14, "(c) license", "//x"),
        (15, f"Copyright (c) 2020 A. Person\n\n{MIT_BODY}", "m/COPYING.md"), (16, "x", "m/n/o"), (17, "# This program is free software: you can redistribute it and/or modify it under\n# the terms of the GNU General Public License as published by the Free Software\n# Foundation, either version 3 of the License, or (at your option) any later version.\n#\n\nprint(1)", "w.py"),
        (18, "Copyright 2001\nAll rights reserved.\n\n" + licenses.TEMPLATES["BSD-3-Clause"][0], "bsd/LICENSE"), (19, None, "bsd/k"), (20, "GPLv3", "g/LICENSE"), (21, "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nlong words follow", "h/COPYING"),
    ]
    df = spark.createDataFrame([(*r, "l", "s", "x", "y", 1, "d") for r in rows], DDL)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert sorted(((r.doc_id, r.license, r.origin, r.from_dir) for r in licenses.scan(df).collect()), key=str) == brute(rows)
    assert licenses.scan(df.limit(0)).collect() == []
    assert {i: got[i].license for i in (15, 16, 17, 18, 19, 20, 21)} == {15: "MIT", 16: "MIT", 17: "GPL-3.0", 18: "BSD-3-Clause", 19: "BSD-3-Clause", 20: "GPL-3.0", 21: "GPL-2.0"}


def test_every_template_finds_its_license(spark):
    rows = [(i, t, f"f{i}") for i, (n, t) in enumerate((n, t) for n, ts in licenses.TEMPLATES.items() for t in ts)]
    names = [n for n, ts in licenses.TEMPLATES.items() for _ in ts]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i].origin for i in range(len(rows))] == ["own"] * len(rows)
    wrong = [(names[i], got[i].license) for i in got if got[i].license != names[i]]
    assert not wrong


def test_a_million_equal_lines(spark):
    rows = [(i, "\n".join([MIT, "and now the same again in other words"] * 25_000), f"d/{i}") for i in range(20)] + [(99, "x", "d/y")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    assert sum(r.n_statements for r in got) == 500_000 and sum(r.license == "MIT" for r in got) == 20


def test_query(spark, table):
    rows = [(i, MIT if i % 3 == 0 else GPL if i == 70 else "x", "p", "en", "s0", "l", "k", 1, "d") for i in range(60, 400)]
    got = {r.doc_id: r for r in licenses.op2_licenses(spark, table(rows, DDL)).collect()}
    assert len(got) == 340 and got[70].license == "GPL-3.0"
    assert {r.from_dir for r in got.values() if r.origin == "inherited"} <= {"s0", "s0/en", "s0/en/0"} and sum(r.origin == "inherited" for r in got.values()) > 200
    assert licenses.op2_licenses(spark, table([], DDL)).collect() == []


def test_query_against_its_sql(spark, table):
    import duckdb

    texts = [MIT, GPL, "x\n\ny", f"a b\n# {MIT_BODY.split(chr(10))[0]}\n# {MIT_BODY.split(chr(10))[1]}\n\nend", None, "", "plain words\nof no license\n\nmore", "SPDX-License-Identifier: ISC", "licence of it's own"]
    rows = [(i * 37, texts[i % len(texts)], "p", "en" if i % 2 else "de", f"s{i % 3}", "l", "k", 1, "d") for i in range(400)]
    d = table(rows, DDL)
    got = licenses.op2_licenses(spark, d)
    db = duckdb.connect()
    db.sql(f"create view documents as from '{d}/documents.parquet/*.parquet'")
    want = db.sql(licenses.oracle_sql())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(*got.columns).fetchall(), key=str)
