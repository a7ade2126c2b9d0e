"""The fast matcher and phrase loops against difflib, the pattern itself and plain restatements; what each of them must not cost."""

import random
import re
import struct
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from velloom.functions import matching, similarity
from velloom.operators import images, lexicon, recognition
from velloom.plans import service


def prose(rng, n):
    words = ["".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n // 6))[:n]


def seconds(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def odd_pairs():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(["ab", "abc ", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz    é日𝒳"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([5, 60, 320])))) for _ in range(2))
        if a and rng.random() < 0.4:
            k = rng.randrange(len(a))
            b = b[: len(b) // 2] + a[k : k + 90] + b[len(b) // 2 :]
        yield a, b


def test_matched_against_difflib():
    for a, b in odd_pairs():
        m = SequenceMatcher(None, a, b)
        blocks = sum(x.size for x in m.get_matching_blocks())
        assert matching.matched(a, b) == (blocks, m.find_longest_match().size), (a, b)
        assert min(matching.common(a, [b, a])) >= blocks and matching.common(a, [a, ""]) == [len(a), 0]


def test_common_against_its_definition():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in odd_pairs():
        if len(a) * len(b) < 4000:
            assert matching.common(a, [b, "", b[:9]]) == [lcs(a, b), 0, lcs(a, b[:9])]


def test_loops_against_the_pattern():
    plain = re.compile(r"(.{12,160}?)(?:\s*\1){2,}", re.S)
    rng = random.Random(4)
    for _ in range(300):
        letters, s = rng.choice(["ab", "a ", "abc \n", "abcdefgh \n", "abcdefghijklmnopqrstuvwxyz    é日𝒳\x1c"]), ""
        for _ in range(rng.randint(0, 8)):
            part = "".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([6, 14, 40, 170]))))
            s += part * rng.choice([1, 1, 2, 3, 5]) if rng.random() < 0.8 else rng.choice(" \n.a") * rng.randint(1, 80)
            s += rng.choice(["", " ", "\n\n"]) + (part + " ") * rng.choice([0, 0, 3])
        assert matching.once(s) == plain.sub(r"\1", s), repr(s)


def test_loops_cost_little():
    s = prose(random.Random(5), 30_000)
    assert 5 * seconds(matching.once, s) < seconds(matching.LOOP.sub, r"\1", s)


def plain_merge(text):
    kept = []
    for line in text.splitlines():
        if not line.strip():
            if kept and kept[-1] != "":
                kept.append("")
            continue
        for k in reversed(range(max(0, len(kept) - 7), len(kept))):
            n, m = len(line.strip()), len(kept[k].strip())
            if m and plain_similarity(line, kept[k]) >= (0.68 if max(n, m) >= 36 else 0.9):
                kept[k] = line if n > m else kept[k]
                break
        else:
            kept.append(line)
    while kept and not kept[-1].strip():
        del kept[-1]
    return "\n".join(kept)


def plain_similarity(a, b):
    x, y = (" ".join(s.casefold().split()) for s in (a, b))
    if not (x and y):
        return 0.0
    m = SequenceMatcher(None, x, y)
    ratio = m.ratio()
    if min(len(x), len(y)) >= 28 and ratio < 0.72 and m.find_longest_match().size >= 22:
        ratio = 0.72
    p, q = set(x.split()), set(y.split())
    return max(ratio, (ratio + len(p & q) / len(p | q)) / 2)


def test_near_lines_against_a_plain_restatement():
    rng = random.Random(6)
    for _ in range(40):
        lines = [prose(rng, rng.choice([0, 8, 30, 60, 150, 240])) for _ in range(8)]
        for _ in range(12):
            x = list(rng.choice(lines))
            for _ in range(rng.randint(0, 1 + len(x) // 4) if x else 0):
                x[rng.randrange(len(x))] = rng.choice("etaoin ")
            lines.insert(rng.randrange(len(lines)), "".join(x) + rng.choice(["", " more", " ".join(x[:9])]))
        assert similarity.merge_near_lines("\n".join(lines)) == plain_merge("\n".join(lines))


def test_near_lines_rarely_need_the_matcher(monkeypatch):
    rng, calls = random.Random(7), []
    monkeypatch.setattr(similarity, "matched", lambda a, b: calls.append(1) or matching.matched(a, b))
    text = "\n".join(prose(rng, rng.randint(60, 190)) for _ in range(200))
    assert similarity.merge_near_lines(text).count("\n") == 199 and len(calls) < 20  # 1400 pairs


def test_line_similarity_costs_little():
    rng = random.Random(8)
    pairs = [(prose(rng, 190), prose(rng, 190)) for _ in range(60)]
    assert [similarity.line_similarity(*p) for p in pairs] == [plain_similarity(*p) for p in pairs]
    assert 3 * seconds(lambda: [similarity.line_similarity(*p) for p in pairs]) < seconds(lambda: [plain_similarity(*p) for p in pairs])


def plain_tail(text, share=0.22):
    long = lambda parts: {w.casefold() for w in re.findall("[А-Яа-яЁё]{5,}", "\n\n".join(parts))}
    parts = re.split(r"\n\s*\n+", text.strip())
    while True:
        for n in (3, 2, 1):
            t = long(parts[-n:])
            if n < len(parts) and len(t) >= 4 and len(t & long(parts[:-n])) >= max(3, share * len(t)):
                del parts[-n:]
                break
        else:
            return "\n\n".join(parts).strip()


def test_repeated_tail_against_a_plain_restatement():
    rng = random.Random(9)
    words = ["".join(rng.choice("абвгде") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    for _ in range(200):
        text = "\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12)))
        assert similarity.drop_repeated_tail(text) == (plain_tail(text) if text else text)


@pytest.mark.parametrize("query", ["stitched_bands", "refine_guard"])
def test_conversations_are_dealt_to_all_partitions(spark, query):
    from velloom.plans import queries

    d = queries.queries()[query](spark, "/root/testdata/sf0.001")
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_look_alikes_make_no_variants(spark):
    made = lexicon.look_alikes(spark.createDataFrame([("n" * 40,), ("nununa",), ("cccxx",)], "word string"), spark.createDataFrame([("u" * 3 + "n" * 37,), ("unuano",), ("eeexx",), ("iiixx",)], "word string"), ("nu", "ec", "ei", "ao"))
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {("n" * 40, "u" * 3 + "n" * 37), ("cccxx", "eeexx")}  # c and i are alike by way of e only


def test_black_and_white_pages_take_a_bit_a_pixel():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 7), (20, 8), (33, 129)):
        page = (rng.random(shape) < 0.5).astype(np.uint8) * np.uint8(255)
        made = images.encode_png(page)
        assert (images.decode_png(made)[:, :, 0] == page).all()
        assert struct.unpack_from(">IIB", made, 16) == (shape[1], shape[0], 1)
    gray = np.array([[0, 255, 1], [254, 128, 127]], np.uint8)
    assert images.encode_png(gray)[24] == 8 and (images.decode_png(images.encode_png(gray))[:, :, 0] == gray).all()


class _Uploads:
    """Keeps what would run on each partition."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_recognised_pages_leave_in_pieces():
    n = 5000
    batch = pa.RecordBatch.from_pydict({"job_id": [str(i) for i in range(n)], "content_type": ["image/png"] * n, "content": [b"x" * 1000 if i % 3 else None for i in range(n)], "lang": ["ru"] * n})
    made = list(recognition.pages_of(_Uploads(), "test", service.read_utf8)(iter([batch, batch.slice(0, 0), batch])))
    assert sum(p.num_rows for p in made) == 2 * n and max(p.num_rows for p in made) <= recognition.MOST_ROWS
    assert max(p.nbytes for p in made) < 2 * recognition.MOST_TEXT
    rows = [r for p in made for r in p.to_pylist()]
    assert [r["job_id"] for r in rows] == [str(i) for i in range(n)] * 2 and rows[1]["text"] == "x" * 1000 and rows[0]["text"] is None and rows[0]["error"]
