"""Text rules as Column expressions. Null texts give null unless stated; Unicode classes follow Python's, not Java's ASCII ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block ends, TeX commands, the labels a chat model puts before its answer.
BLOCK_ENDS = "div|p|h[1-6]|li|ul|ol|tr|table|section|blockquote"
TEX_COMMANDS = "frac|array|hline|cdot|left|right|mathrm|text|begin|end"
LABELS = ("Исправленный текст:", "Исправленный текст", "Текст:")
#: Entities that a Column can decode; ``&amp;`` goes last. The full set needs similarity.html_to_text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Inside a lambda Catalyst would compute an outer expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def words(c: Column) -> Column:
    """Words split at white space."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), F.lit(1))


def word_count(c: Column) -> Column:
    """AGG4: words outside of markup; 0 for null."""
    return F.regexp_count(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), F.lit(r"(?U)\w+"))


def squeeze_lines(c: Column) -> Column:
    """WIN3: lines stripped, runs of blank lines reduced to one, none at either end."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\n]*\n[^\S\n]*", "\n"), r"\n{3,}", "\n\n"))


def html_to_text(c: Column) -> Column:
    """SCL1 without the loop rules: markup to lines and blocks. Texts without '<' are only stripped."""
    s = F.regexp_replace(c, r"(?i)<img[^>]*>", "")
    s = F.regexp_replace(s, r"(?iU)<br\s*/?>", "\n")
    s = F.regexp_replace(s, f"(?i)</({BLOCK_ENDS})>", "\n\n")
    s = F.regexp_replace(s, "<[^>]+>", "")
    s = F.regexp_replace(s, r"(?dm)<[a-zA-Z][^>\n]*$", "")
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.when(F.contains(c, F.lit("<")), squeeze_lines(s)).otherwise(strip(c))


def drop_tex(c: Column) -> Column:
    """SCL7: TeX environments, inline formulas, commands; then blanks before line ends and runs of newlines."""
    s = F.regexp_replace(c, r"(?s)\\begin\{[a-zA-Z*]+\}.*?\\end\{[a-zA-Z*]+\}", "")
    s = F.regexp_replace(s, r"\$\$.*?\$\$|\$[^$\n]+\$", "")
    s = F.regexp_replace(s, rf"(?U)\\(?:{TEX_COMMANDS})(?:\s*\{{[^{{}}]*\}})*", "")
    s = F.regexp_replace(s, r"\\[a-zA-Z]+\*?", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def phrase_loops(c: Column) -> Column:
    """SCL3: a phrase of 12 to 160 characters that stands three times or more in a row stands once."""
    return F.regexp_replace(c, r"(?sU)(.{12,160}?)(?:\s*\1){2,}", "$1")


def looks_like_form(c: Column) -> Column:
    """FLT4: leftover layout markup, blanks to fill in, a number in angle quotes."""
    return F.coalesce(F.contains(c, F.lit("data-bbox")) | F.contains(F.lower(c), F.lit("<div")) | F.contains(c, F.lit("___")) | c.rlike(r"(?U)«\s*\d|\d\s*»"), F.lit(False))


def prefer_original(source: Column, candidate: Column, script: str = "[А-Яа-яЁё]") -> Column:
    """FLT5: the source where the candidate lost its letters, turned Latin or grew out of proportion; else the candidate as it is."""
    src, dst = F.coalesce(source, F.lit("")), strip(F.coalesce(candidate, F.lit("")))
    own, got, latin = F.regexp_count(src, F.lit(script)), F.regexp_count(dst, F.lit(script)), F.regexp_count(dst, F.lit("[A-Za-z]"))
    lost = (own >= 4) & (got < F.greatest(F.lit(2), (own * 0.5).cast("int")))
    soup = (own >= 4) & (latin >= 3) & (latin >= got)
    grown = F.length(dst) > F.greatest(F.lit(80), (F.length(src) * 2.8).cast("int"))
    return F.when((dst == "") | lost | soup | grown, source).otherwise(candidate)


def strip_completion(c: Column) -> Column:
    """SCL9: an answer without fences and leading labels."""
    s = strip(F.regexp_replace(strip(c), r"(?dmU)^```(?:\w+)?\s*|\s*```$", ""))
    for label in LABELS:
        rest = F.regexp_replace(F.substring(s, len(label) + 1, 1_000_000_000), r"^[ \n:]+", "")
        s = F.when(F.startswith(F.lower(s), F.lit(label.lower())), rest).otherwise(s)
    return strip(s)


def sentence_units(line: Column) -> Column:
    """SCL10: the sentences of a line; a blank line is its own unit."""
    cut = F.filter(F.transform(F.split(line, r"(?U)(?<=[.!?…])\s+"), strip), lambda x: x != "")
    return F.when(is_blank(line), F.array(line)).otherwise(cut)


def pack(units: Column, limit: int, joiner: str) -> Column:
    """WIN8: consecutive units joined into packs of at most ``limit`` words; a longer unit is a pack of its own."""
    sized = F.transform(units, lambda u: F.struct(u.alias("u"), F.size(words(u)).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = a.open.isNotNull() & (a.n + x.n > limit)
        joined = F.when(a.open.isNull() | full, x.u).otherwise(F.concat(a.open, F.lit(joiner), x.u))
        return F.struct(F.when(full, F.array_append(a.done, a.open)).otherwise(a.done).alias("done"), joined.alias("open"), F.when(full, x.n).otherwise(a.n + x.n).alias("n"))

    return F.aggregate(sized, start, step, lambda a: F.when(a.open.isNull(), a.done).otherwise(F.array_append(a.done, a.open)))


def chunks(c: Column, limit: int) -> Column:
    """WIN9: words in runs of ``limit``, joined by spaces."""
    return runs_of(words(c), limit)


def runs_of(array: Column, limit: int) -> Column:
    """Elements in runs of ``limit``, joined by spaces; an empty array gives one empty run."""
    return let(array, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / limit).cast("int"))), lambda k: F.array_join(F.slice(w, k * limit + 1, limit), " ")))


def norm_line(c: Column) -> Column:
    """SCL4: case-folded (ß as ss), single spaces."""
    return strip(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """AGG14, SCL5: overlap of the word sets of two lines; 0 where either has none."""
    return overlap(*(F.array_distinct(words(norm_line(c))) for c in (a, b)))


def overlap(x: Column, y: Column) -> Column:
    """Jaccard overlap of two sets, given as arrays; 0 where either is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def neighbour_overlaps(c: Column) -> Column:
    """AGG14 within a row: the overlap of each line but the first with the line before it; each line is cut into words once."""
    sets = F.transform(F.split(c, "\n"), lambda x: F.array_distinct(words(norm_line(x))))
    return let(sets, lambda w: F.transform(F.filter(w, lambda x, i: i > 0), lambda x, i: overlap(F.get(w, i), x)))


def match_case(source: Column, candidate: Column) -> Column:
    """SCL14: the candidate in the source's case: all upper, first upper, or as it is."""
    first = F.substring(source, 1, 1)
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    return F.when(upper(source), F.upper(candidate)).when(upper(first), F.concat(F.upper(F.substring(candidate, 1, 1)), F.substring(candidate, 2, 1_000_000_000))).otherwise(candidate)


def select_text(which: Column, text: Column, corrected: Column) -> Column:
    """PRJ2: the corrected text if asked for and not empty, else the text, else ''."""
    return F.when((which == "corrected") & (F.length(corrected) > 0), corrected).otherwise(F.coalesce(text, F.lit("")))


def human_bytes(c: Column) -> Column:
    """SCL19: bytes with one decimal in the first unit below 1024, GB at most."""
    x = c.cast("double")
    out = F.format_string("%.1f GB", F.bround(x / 1024**3, 1))
    for k, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(x / 1024**k < 1024, F.format_string(f"%.1f {unit}", F.bround(x / 1024**k, 1))).otherwise(out)
    return out


def progress(base: Column, fraction: Column, span: Column) -> Column:
    """WIN10: overall progress, never beyond 0.999 before the end."""
    return F.least(F.lit(0.999), F.greatest(F.lit(0.0), base + fraction * span))


def phase(name: Column, page: Column, pages: Column) -> Column:
    """WIN10: a phase, with its page (from 0) where a document has several."""
    return F.when(pages == 1, name).otherwise(F.concat(name, F.lit(" · стр. "), (page + 1).cast("string"), F.lit("/"), pages.cast("string")))


def correction_progress(fraction: Column) -> Column:
    """WIN10: progress of the correction, the last hundredth of a job; null counts as 0."""
    return F.least(F.lit(0.999), F.lit(0.99) + F.lit(0.009) * F.coalesce(fraction, F.lit(0.0)))


def token_progress(nth: Column, estimate: Column, offset: Column, span: Column) -> Column:
    """STR5: progress after the ``nth`` put of a token stream, whose first is the prompt: null for it, 0.98 at most."""
    return F.when(nth > 0, F.least(F.lit(0.98), offset + span * (nth / F.greatest(F.lit(32), estimate))))


def clip(c: Column, most: int = 1800) -> Column:
    """ORD4: the first ``most`` code points of the stripped text; '' for null."""
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, most)


def truthy(c: Column) -> Column:
    """FLT8: whether a setting is on; a missing one is off, any text but a word for no is on."""
    return F.coalesce(~F.lower(strip(c)).isin("0", "false", "no", "off"), F.lit(False))


def first_set(*settings: Column) -> Column:
    """PRJ3: the first setting that isn't null or blank."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in settings))


def repeats_head(head: Column, tail: Column, script: str = "[А-Яа-яЁё]", least: int = 5) -> Column:
    """FLT10: whether a tail says again what the head says, by their distinct long words; false for null."""
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({script}{{{least},}})"), F.lit(1)))
    a, b = long_words(head), long_words(tail)
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce((F.size(b) >= 4) & (F.size(a) > 0) & (shared >= 3) & (shared / F.greatest(F.size(b), F.lit(1)) >= 0.22), F.lit(False))
