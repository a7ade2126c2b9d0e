import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from velloom.functions import similarity as sim
from velloom.functions import text
from velloom.operators import correction, lines, series
from velloom.sources import exports


def one(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(args))))).first()[0]


def test_html():
    raw = '<div data-bbox="7 7 9 9"><h1>Опись вещей</h1></div><section><p>Ключ медный,<br>замок старый.</p><img src="x"/></section><ul><li>и верёвка</li></ul>'
    assert sim.html_to_text(raw) == "Опись вещей\n\nКлюч медный,\nзамок старый.\n\nи верёвка"
    assert sim.html_to_text("одно слово") == "одно слово" and sim.html_to_text(None) == "" and sim.html_to_text("a &amp; b") == "a &amp; b"
    assert sim.html_to_text("<b>a &amp;&lt; b</b>") == "a &< b"
    loop = "ключ лежал под ковром у двери "
    got = sim.html_to_text("опись " + loop * 30)
    assert got.count(loop.strip()) <= 2 and len(got) < 200 and got.startswith("опись")
    assert sim.collapse_loops("\n".join(["три четыре"] + ["верёвка лежит на верхней полке"] * 50)).count("верёвка") <= 2


def test_tex(spark):
    raw = "Сколько?\n\\begin{array}{c} 5 \\hline \\end{array}\n7/3 $y-2$ \\frac{3}{4} всё"
    got = one(spark, text.drop_tex, raw)
    assert got == "Сколько?\n\n7/3   всё" and sim.collapse_loops(raw) == got


def test_similar_lines():
    assert sim.line_similarity("", "a") == 0 and sim.line_similarity("Maße  drei", "masse drei") == 1
    a, b = "Старый замок открывается медным ключом", "Старый замак открывается медным ключом легко"
    assert sim.merge_near_lines(f"{a}\n\n\n{b}\nконец") == f"{b}\n\nконец"
    draft = " ".join(["полка"] * 40)
    assert sim.prefer_refined(draft, "пусто") == draft and sim.prefer_refined(draft, draft) == draft
    tail = "Верёвка хранится отдельно вместе остальными предметами"
    assert sim.drop_repeated_tail(f"{tail} всегда\n\nникто ничего больше найти здесь сумел\n\n{tail}").count("Верёвка") == 1


def test_stitched_bands(spark):
    a, b, c = "на верхней полке лежит верёвка", "под ковром спрятан медный ключ", "замок висит на старой двери"
    assert sim.stitch(["<p>раз</p>"]) == "раз"
    assert sim.stitch([f"{a}\n{b}", f"{b}\n{c}"]) == f"{a}\n{b}\n\n{c}"
    assert sim.stitch([f"{a}\n{b}", f"пад ковром спрятан медный ключ\n{c}"]).count("ключ") == 1
    assert sim.stitch([f"x\n{a}\n{b}\n{c}", f"{a}\n{b}\n{c}\n\nиная строка", None, ""]) == f"x\n{a}\n{b}\n{c}\n\nиная строка"
    d = spark.createDataFrame([(["<b>раз</b>", None, "два"],), ([],)], "bands array<string>")
    assert [r[0] for r in d.select(sim.each(sim.stitch)(F.col("bands"))).collect()] == ["раз\n\nдва", ""]


def test_refined_heading_comes_back():
    body = "верёвка лежит на полке рядом\nключ спрятан под ковром дома\nзамок висит на двери сарая"
    draft = f"Опись вещей\n\n{body}"
    refined = f"Совсем иное начало письма\n\n{body} теперь"
    assert sim.prefer_refined(draft, refined) == f"Опись вещей\n\n{body} теперь"
    assert sim.prefer_refined(draft, "Ничего похожего " * 12) == draft
    assert sim.prefer_refined(f"  \nОпись вещей\n{body}", f"Иное\nначало\n{body}\n\n") == f"Опись вещей\n{body}"


def test_guards(spark):
    long = "Опись старых вещей, которые лежат на верхней полке"
    assert one(spark, text.prefer_original, long, ".. ,BCK.OPQ.") == long
    assert one(spark, text.prefer_original, "Ключ под ковром", "Ключ под ковром.") == "Ключ под ковром."
    assert one(spark, text.prefer_original, "Ключ под ковром", " ") == "Ключ под ковром"
    for s, want in (("от « 3 » мая", True), ("сумма ____ рублей", True), ('<DIV class="x"', True), ("Полка прибита.", False), ("data-bbox", True)):
        assert one(spark, text.looks_like_form, s) is want
    assert one(spark, text.strip_completion, "```text\nОпись\n```") == "Опись"
    assert one(spark, text.strip_completion, "Исправленный текст:\nПолка прибита") == "Полка прибита"


def test_packs(spark):
    unit = "Полка прибита крепко. "
    got = one(spark, lambda c: text.pack(text.sentence_units(c), 24, " "), unit * 20)
    assert [len(p.split()) for p in got] == [24, 24, 12]
    got = one(spark, lambda c: correction.packs(c, 220, "\n"), "\n".join(["полка"] * 250))
    assert [len(p.split()) for p in got] == [220, 30]


def test_lexicon():
    known = frozenset({"чужина", "ключи", "полка", "дождик"})
    odd = "".join({"ч": "л", "у": "о", "ж": "и"}.get(c, c) for c in "чужина")
    assert sim.fix_cursive(f"Здесь {odd} и {odd.upper()}, ключи", known) == "Здесь чужина и ЧУЖИНА, ключи"
    assert sim.fix_cursive("Полка, ключи", known) == "Полка, ключи"
    assert sim.spell("Палка у двери Двиря", {"полка": 9, "двери": 5, "двиря": 1, "пилка": 3}) == "Полка у двери Двиря"


def test_series():
    p = np.zeros(200)
    p[[20, 90, 150]] = [10, 8, 9]
    p[100] = 3
    assert series.peaks(series.smooth(p, 1), 38, 0.6).tolist() == [20, 90, 150]
    line = np.zeros((60, 400), np.uint8)
    for a in (10, 110, 210, 310):
        line[20:40, a : a + 50] = 255
    assert len(series.word_ranges(line)) == 4
    bands = series.page_bands(1800, [600, 1200])
    assert len(bands) == 3 and bands[0][0] == 0 and bands[-1][1] == 1800 and all(b - a > 500 for a, b in bands)
    assert series.page_bands(400, []) == [(0, 400)]


def test_exports(spark):
    body = "Ключ & <полка>\nзамок\n\nверёвка"
    assert exports.build(body, "txt") == exports.build(body, "md") == body.encode()
    with pytest.raises(ValueError):
        exports.build(body, "rtf")
    word = zipfile.ZipFile(io.BytesIO(exports.build(body, "docx"))).read("word/document.xml").decode()
    assert word.count("<w:p>") == 2 and word.count("<w:br/>") == 1 and "&lt;полка&gt;" in word
    sheet = zipfile.ZipFile(io.BytesIO(exports.build(body, "xlsx"))).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 4 and "<v>3</v>" in sheet
    assert exports.build(None, "pdf").startswith(b"%PDF") and exports.build("", "txt") == b""
    r = exports.files(spark.createDataFrame([("0123456789ab", body)], "id string, text string"), "id", "text", "docx").first()
    assert r.file_name == "ocr-01234567.docx" and r.content[:2] == b"PK"


def test_settings_clips_and_tails(spark):
    rows = [(None, None, None), ("", " ", "x"), (" OFF", "a", None), ("yes", None, " b "), ("0", "", "")]
    d = spark.createDataFrame(rows, "a string, b string, c string")
    got = d.select(text.truthy(F.col("a")), text.first_set(F.col("b"), F.col("c")), text.clip(F.col("c"), 1)).collect()
    assert [tuple(r) for r in got] == [(False, None, ""), (True, "x", "x"), (False, "a", ""), (True, "b", "b"), (False, None, "")]
    say = "alpha bravos charlie deltas"
    d = spark.createDataFrame([(say, say), (say, "deltas bravos charlie"), (say, None), ("", say), (say, say.upper())], "a string, b string")
    assert [r[0] for r in d.select(text.repeats_head(F.col("a"), F.col("b"), "[a-z]")).collect()] == [True, False, False, False, True]


def test_regroup_and_lexicon_with_nulls(spark):
    d = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 2, 5, "c"), (1, 1, 4, " "), (1, 3, 6, None)], "doc long, line long, at long, word string")
    assert [tuple(r) for r in lines.regroup(d, "doc", "line", "at", "word").collect()] == [(1, "a b\nc", 2)]
    known = spark.createDataFrame([("A",), ("a",), (None,)], "word string")
    assert sorted(str(r.word) for r in lines.unknown_words(d, known).collect()) == [" ", "None", "b", "c"]
    assert lines.regroup(d.limit(0), "doc", "line", "at", "word").collect() == []
