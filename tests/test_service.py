"""Correction, images, PDF files, lexicon joins and recognition, against plain restatements of their rules."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velloom.functions import routing, text
from velloom.operators import correction, images, jobs, lexicon, lines, recognition, series
from velloom.sources import exports


def plain_units(line):
    return [line] if not line.strip() else [x.strip() for x in re.split(r"(?<=[.!?…])\s+", line) if x.strip()] or [line]


def plain_packs(t, limit, joiner):
    out, held, n = [], [], 0
    for line in t.split("\n"):
        for u in plain_units(line):
            w = len(u.split())
            if held and n + w > limit:
                out.append(joiner.join(held))
                held, n = [], 0
            held.append(u)
            n += w
    return [*out, joiner.join(held)] if held else out


def plain_correct(t, model, seq2seq):
    if t is None:
        return None
    limit = 24 if seq2seq else 220
    one = lambda s: s if not s.strip() or re.search(r"data-bbox|<div|___|«\s*\d|\d\s*»", s) else model(s)
    if "<" in t and ">" in t:
        def node(m):
            w = m[1].split(" ")
            return " ".join(one(" ".join(w[i : i + limit])) for i in range(0, len(w), limit))

        return re.sub(r"(?<=>)([^<>]+)(?=<)", node, t)
    if not seq2seq:
        return "\n".join(map(one, plain_packs(t, limit, "\n")))
    return "".join(x if not x.strip() else " ".join(map(one, plain_packs(x, limit, " "))) for x in re.split(r"(\n+)", t))


def odd_texts():
    rng = random.Random(1)
    bits = ["полка", "key", "замок.", "да!", "…", " ", "\n", "\n\n", "<b>", "</b>", "<div>", ">", "<", "« 5 »", "___", "  ", "конец?"]
    made = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    plain = [" ".join(rng.choice([b for b in bits if "<" not in b and ">" not in b]) for _ in range(rng.randint(0, 600))) for _ in range(60)]
    return [None, "", " ", "\n\n", "a", *made, *plain]


@pytest.mark.parametrize("seq2seq", [True, False])
def test_correction_against_plain_python(spark, seq2seq):
    texts = odd_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.corrected for r in correction.correct(d, "k", "text", lambda c: F.concat(F.lit("["), c, F.lit("]")), seq2seq).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_correct(t, lambda s: f"[{s}]", seq2seq), repr(t)
    totals = [r[0] for r in d.orderBy("k").select(correction.total_packs(F.col("text"))).collect()]
    assert totals == [max(1, sum(len(plain_packs(x, 24, " ")) for x in re.split(r"(\n+)", t or "") if x.strip())) for t in texts]


def test_correction_with_an_arrow_model(spark):
    from velloom.functions.similarity import each

    seen = spark.createDataFrame([(1, "one two.\n\n« 5 »"), (2, None)], "k long, text string")
    model = each(lambda s: s.upper() if "5" not in s else 1 / 0)  # a form must never reach it
    assert {r.k: r.corrected for r in correction.correct(seen, "k", "text", model).collect()} == {1: "ONE TWO.\n\n« 5 »", 2: None}
    assert correction.correct(seen.limit(0), "k", "text", model).collect() == []


def test_line_rules_are_linear_and_exact(spark):
    rng = random.Random(2)
    rows = [["", " ", "a", "b"][rng.randrange(4)] for _ in range(300)]
    t = "\n".join(rows)
    d = spark.createDataFrame([(1, t), (2, ""), (3, None), (4, " \n ")], "k long, text string")
    want = [x for i, x in enumerate(rows) if i < 2 or not x == rows[i - 1] == rows[i - 2]]
    got = sorted((r.line_no, r.line) for r in lines.cap_runs(d, ["k"]).where("k = 1").collect())
    assert [x for _, x in got] == want
    blocks, now = [], []
    for x in [*rows, ""]:
        if x.strip():
            now.append(x)
        elif now:
            blocks.append("\n".join(now))
            now = []
    got = sorted((r.k, r.block_no, r.block, r.n_lines) for r in lines.paragraphs(d, ["k"]).collect())
    assert got == [(1, i, b, b.count("\n") + 1) for i, b in enumerate(blocks)]
    assert [r.line for r in lines.sheet_rows(d, ["k"]).orderBy("k", "row_no").collect()] == [x for x in rows if x.strip()]
    long = spark.createDataFrame([("\n".join(f"line {i} of many" for i in range(40_000)),)], "text string")
    sizes = long.select(F.size(lines.cap_runs_in_place(F.col("text"))), F.size(text.chunks(F.col("text"), 24)), F.size(text.neighbour_overlaps(F.col("text"))), F.size(correction.packs(F.col("text"), 220, "\n"))).first()
    assert tuple(sizes) == (40_000, -(-160_000 // 24), 39_999, -(-40_000 // 55))


def test_zip_counts_and_directories(spark):
    d = spark.createDataFrame([(["a", "b", "c"], [1, 2]), ([], [1]), (None, [1])], "a array<string>, b array<int>")
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in d.select(lines.zip_shortest(F.col("a"), F.col("b"), "x", "y")).collect()] == [[("a", 1), ("b", 2)], [], None]
    assert d.limit(1).select(lines.page_count(F.col("a"))).first()[0] == 3
    with pytest.raises(Exception, match="no pages found"):
        d.select(lines.page_count(F.col("a"))).collect()
    f = spark.createDataFrame([("a/b/c", 5), ("a/d", 2), ("e", 1), (None, 9)], "path string, length long")
    assert {r.directory: (r.bytes, r.files) for r in lines.directory_sizes(f).collect()} == {"": (8, 3), "a": (7, 2), "a/b": (5, 1)}


def test_settings_and_results(spark):
    d = spark.createDataFrame([(None, None), ("", "own"), ("x/FRED", None)], "m string, t string")
    got = d.select(routing.model_id(F.col("m")).alias("m"), routing.tokenizer_id(F.col("t"), routing.model_id(F.col("m"))).alias("t")).collect()
    assert [tuple(r) for r in got] == [(routing.DEFAULT_MODEL, routing.TOKENIZERS[routing.DEFAULT_MODEL]), (routing.DEFAULT_MODEL, "own"), ("x/FRED", "x/FRED")]
    w = spark.createDataFrame([([(" a ", "50"), ("b", "x"), (" ", "9"), ("c", None), ("d", "70.5")],), (None,)], "w array<struct<text:string,confidence:string>>")
    assert [r[0] for r in w.select(jobs.mean_confidence(F.col("w"))).collect()] == [60.25, None] or [r[0] for r in w.select(jobs.mean_confidence(F.col("w"))).collect()] == [60.25, 0.0]
    r = w.select(jobs.response(jobs.result(F.lit("t"), F.lit("e"), F.lit(None).cast("double"), F.lit(None).cast("array<struct<text:string,confidence:double>>")))).first()[0]
    assert r == '{"text":"t","engine":"e","confidence":null,"words":[]}'


def slow_peaks(p, distance, prominence):
    """Peaks by their definition."""
    tops = []
    for i in range(1, len(p) - 1):
        a = i
        while a > 0 and p[a - 1] == p[i]:
            a -= 1
        b = i
        while b < len(p) - 1 and p[b + 1] == p[i]:
            b += 1
        if 0 < a and b < len(p) - 1 and p[a - 1] < p[i] > p[b + 1] and i == (a + b) // 2:
            tops.append(i)
    kept = []
    for i in sorted(tops, key=lambda i: (-p[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        lows = []
        for step in (-1, 1):
            j, low = i, p[i]
            while 0 <= j < len(p) and p[j] <= p[i]:
                low = min(low, p[j])
                j += step
            lows.append(low)
        if p[i] - max(lows) >= prominence:
            out.append(i)
    return out


def test_peaks_against_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = series.smooth(rng.integers(0, 9, rng.integers(5, 120)).astype(float), int(rng.choice([1, 3])))
        d, h = int(rng.integers(1, 12)), float(rng.random() * 3)
        assert series.peaks(p, d, h).tolist() == slow_peaks(p, d, h)


def test_lines_and_words_of_a_page():
    page = np.zeros((400, 560), np.uint8)
    rows = [(30, 60), (110, 140), (190, 220), (300, 330)]
    for k, (a, b) in enumerate(rows):
        for x in range(20, 20 + 120 * (k + 1), 120):
            page[a:b, x : x + 60] = 255
    bands = images.line_bands(page)
    assert len(bands) == 4 and all(a <= y0 and y1 <= b for (a, b), (y0, y1) in zip(bands, rows)) and all(a[1] <= b[0] for a, b in zip(bands, bands[1:]))
    crops = images.word_crops(page, page)
    assert [i for i, _ in crops] == [0, 1, 1, 2, 2, 2, 3, 3, 3, 3] and all(c.max() == 255 for _, c in crops)
    assert images.line_bands(np.zeros((50, 50), np.uint8)) == [(0, 50)]
    assert images.crop(page, (0, 10), (550, 560)).shape == (16, 16)
    # two lines that almost touch, far above the usual height, are told apart by the second look
    close = np.zeros((600, 300), np.uint8)
    for y in (20, 80, 140, 200):
        close[y : y + 30, 20:280] = 255
    close[300:330, 20:280] = close[345:375, 20:280] = 255
    close[330:345, 20:40] = 255
    assert len(images.line_bands(close)) == 6


def test_word_ranges_against_a_loop():
    rng = np.random.default_rng(4)
    for _ in range(100):
        ink = np.repeat((rng.random((1, rng.integers(1, 40))) < 0.5) * 255, rng.integers(1, 20), axis=1).repeat(20, axis=0)
        column = np.convolve(ink.sum(axis=0) / 255, np.ones(5) / 5, mode="same") > 0.4
        want, start = [], None
        for x, on in enumerate([*column, False]):
            if on and start is None:
                start = x
            elif not on and start is not None:
                if want and start - want[-1][1] < 12:
                    want[-1] = (want[-1][0], x)
                else:
                    want.append((start, x))
                start = None
        assert series.word_ranges(ink) == [(a, b) for a, b in want if b - a >= 8]


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(5)
    for shape in ((7, 5), (9, 4, 3), (3, 8, 4)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.decode_png(images.encode_png(image)).reshape(shape) == image).all()
    image = rng.integers(0, 256, (10, 6, 3)).astype(np.uint8)
    raw = image.reshape(10, -1).astype(int)
    body = b""
    for y, line in enumerate(raw):  # each of the five filters, by the format's definition
        kind = y % 5
        out = []
        for i, v in enumerate(line):
            a, b, c = (line[i - 3] if i > 2 else 0), (raw[y - 1][i] if y else 0), (raw[y - 1][i - 3] if y and i > 2 else 0)
            best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, best][kind]) % 256)
        body += bytes([kind, *out])
    made = images.encode_png(image)
    at = made.index(b"IDAT")
    n = int.from_bytes(made[at - 4 : at], "big")
    packed = zlib.compress(body)
    made = made[: at - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + made[at + 4 + n :]
    assert (images.decode_png(made) == image).all()
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_valleys():
    p = np.ones(100)
    p[[20, 25, 60]] = [0.2, 0.1, 0.0]
    assert images.valleys(p) == [25, 60] and images.valleys(np.zeros(3)) == [1] and images.valleys(np.array([])) == []
    page = np.full((1000, 30), 250)
    page[500:520] = 0
    assert images.row_ink(page).argmax() in range(500, 520)


def test_pdf_pages_and_fonts():
    body = "\n\n".join(f"Block {i} with (some) words & signs " * 6 for i in range(60))
    made = exports.build(body, "pdf")
    assert made.startswith(b"%PDF-1.4") and made.rstrip().endswith(b"%%EOF") and made.count(b"/Type /Page ") > 2
    streams = [zlib.decompress(x.split(b"endstream")[0]) for x in made.split(b"stream\n")[1::2] if x[:1] == b"x"]
    shown = b" ".join(re.findall(rb"\((.*?)\) Tj", b"".join(streams))).replace(b"\\", b"")
    assert shown.split() == body.encode().split()
    at = int(made.split(b"startxref\n")[1].split()[0])
    assert made[at : at + 4] == b"xref"
    for line in made[at:].split(b"\n")[3:6]:
        assert re.match(rb"\d+ 0 obj", made[int(line.split()[0]) :])
    assert exports.build("", "pdf").count(b"/Type /Page ") == 1
    font = exports.first_font(["/nowhere.ttf", "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"])
    if font:
        own = exports.TrueType(font)
        assert own.glyph("A") != own.glyph("Ж") > 0 and own.glyph("") == 0 and own.width("W") > own.width("i") > 0
        made = exports.build("Ключ", "pdf", font)
        assert b"/FontFile2" in made and "".join(f"{own.glyph(c):04x}" for c in "Ключ").encode() in b"".join(zlib.decompress(x.split(b"\nendstream")[0]) for x in made.split(b"stream\n") if x[:1] == b"x")
    assert exports.first_font([]) is None


def test_lexicon_joins_against_plain_python(spark):
    from velloom.functions import similarity

    rng = random.Random(6)
    pairs = ("ab", "cd", "ef", "bc")
    word = lambda n: "".join(rng.choice("abcdefx") for _ in range(n))
    known = [word(6) for _ in range(3000)]
    asked = [word(6) for _ in range(300)] + [None, "abc", known[0].upper()]
    alike = {}
    for x, y in pairs:
        alike.setdefault(x, set()).add(y)
        alike.setdefault(y, set()).add(x)
    alike = {k: "".join(sorted(v)) for k, v in alike.items()}
    words, lex = (spark.createDataFrame([(x,) for x in xs], "word string") for xs in (asked, known))
    want = {w: p for w in {x.lower() for x in asked if x and len(x) >= 5} if w not in known and (p := similarity.cursive_pick(w, frozenset(known), alike))}
    assert want and {r.word: r.pick for r in lexicon.look_alikes(words, lex, pairs).collect()} == want
    freq = {w: 1 + i % 3 for i, w in enumerate(dict.fromkeys(known))}
    table = spark.createDataFrame(list(freq.items()), "word string, n long")
    want = {w: p for w in {x.lower() for x in asked if x and len(x) >= 4} if w not in freq and (p := re.sub("[a-z]", lambda m: m[0], plain_spell(w, freq))) != w}
    assert want and {r.word: r.pick for r in lexicon.one_edit(words, table).collect()} == want
    assert {r.word for r in lexicon.in_lexicon(words, lex).collect()} == {x for x in asked if x and len(x) > 1 and x.lower() in freq}


def plain_spell(w, freq, letters="abcdefx"):
    near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
    return max((x for x in near if x in freq and x != w and len(x) >= 4), key=lambda x: (freq[x], x), default=w)


def test_recognition(spark):
    def engine():
        def read(content, lang):
            if content == b"bad":
                raise RuntimeError("no text here")
            return {"text": f"{lang}:{content.decode()}", "confidence": 40.0, "words": [{"text": "w", "confidence": 40.0}]}

        return read

    def opener(kind, content):
        if content == b"shut":
            raise ValueError("can't be opened")
        return content.split(b"|") if kind == "application/pdf" else [content]

    rows = [
        ("a", "image/png", b"one", "ru", "tesseract", "none"), ("b", "application/pdf", b"p1|p2|p3", "ru", "trocr", "context"), ("c", "image/png", b"bad", "ru", "trocr", "none"),
        ("d", "image/gif", b"x", "ru", "trocr", "none"), ("e", "image/png", None, "ru", "trocr", "none"), ("f", "image/png", b"x", "ru", "chandra", "none"), ("g", "application/pdf", b"shut", "ru", "trocr", "none"),
        ("h", "image/png", b"x", "ru", "trocr", "magic"),
    ]
    d = spark.createDataFrame(rows, "job_id string, content_type string, content binary, lang string, engine string, corrector string")
    got = {r.job_id: r for r in recognition.recognize(d, {"tesseract": engine, "trocr": engine}, {"context": lambda x: x.select("job_id", F.upper("text").alias("corrected"))}, opener).collect()}
    assert [got[k].http_status for k in "abcdefgh"] == [200, 200, 200, 415, 400, 200, 200, 400]
    assert [got[k].status for k in "abcdefgh"] == ["done", "done", "error", None, None, "error", "error", None]
    assert (got["a"].text, got["a"].confidence, got["a"].words, got["a"].text_corrected) == ("ru:one", 40.0, 2, None)
    assert (got["b"].text, got["b"].confidence, got["b"].pages, got["b"].text_corrected) == ("ru:p1\n\nru:p2\n\nru:p3", None, 3, "RU:P1\n\nRU:P2\n\nRU:P3")
    assert got["c"].error == "no text here" and got["g"].error == "can't be opened" and got["c"].text is None and got["f"].error
    assert recognition.recognize(d.limit(0), {"trocr": engine}).collect() == []


def test_exclusive_models():
    out = []
    cache = recognition.ModelCache(frozenset({"a", "b"}), out.append)
    assert cache.load("a", lambda: "A") == "A" and cache.load("c", lambda: "C") == "C" and cache.load("b", lambda: "B") == "B"
    assert out == ["A"] and set(cache.held) == {"b", "c"} and cache.load("b", lambda: 1 / 0) == "B"
    assert cache.load("a", lambda: "A2") == "A2" and out == ["A", "B"]
    cache.unload("zzz")


def test_engines_around_models():
    from velloom.plans.service import picture

    page = picture(["ab    c", "ddd"])
    seen = []

    def read(crops):
        seen.append(len(crops))
        return [f" w{c.shape[1]} " if c.shape[1] > 40 else "  " for c in crops]

    got = recognition.by_words(read, lambda p: np.where(images.gray(p) < 128, 255, 0), 2)(images.encode_png(page), "ru")
    assert seen == [2, 1] and got["text"].count("\n") <= 1 and got["confidence"] is None and all(w["text"].startswith("w") for w in got["words"])
    tall = np.full((1800, 60), 255, np.uint8)
    for y in range(100, 1700, 200):
        tall[y : y + 60, 10:50] = 0
    asked = []

    def model(band, prompt, budget):
        asked.append((band.shape[0], prompt, budget))
        return f"<p>строка номер {len(asked)}</p>"

    got = recognition.by_bands(model, prompt="read")(images.encode_png(tall), "ru")
    assert len(asked) == 3 and {a[1:] for a in asked} == {("read", 1536)} and sum(a[0] for a in asked) > 1800 and "<" not in got["text"]
    asked.clear()
    short = recognition.by_bands(model, refine=lambda t: f"again {t}")(images.encode_png(tall[:400]), "ru")
    assert [a[1:] for a in asked] == [(None, 2048), ("again строка номер 1", 2048)] and short["text"] == "строка номер 1"
