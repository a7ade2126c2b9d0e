"""Order-dependent text rules that Column expressions can't state; plain functions of one text, and Arrow UDFs of them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import common, matched, once, shares
from .text import BLOCK_ENDS, TEX_COMMANDS

#: Similarity that makes two lines one (long lines, short lines), lines looked back, overlap of bands.
LONG_ALIKE, SHORT_ALIKE, LONG_LINE, LOOK_BACK = 0.68, 0.9, 36, 7
MOST_OVERLAP, OVERLAP_LEAST, OVERLAP_MEAN = 6, 0.5, 0.62
#: Letters that look alike in handwriting.
ALIKE = ("чл", "щц", "щш", "нк", "дз", "жи", "уо")
#: Patterns of markup, TeX, loops and long words.
LONG_WORD = re.compile("[А-Яа-яЁё]{5,}")
_MARKUP = ((re.compile(r"<img[^>]*>", re.I), ""), (re.compile(r"<br\s*/?>", re.I), "\n"), (re.compile(f"</({BLOCK_ENDS})>", re.I), "\n\n"), (re.compile("<[^>]+>"), ""), (re.compile(r"<[a-zA-Z][^>\n]*$", re.M), ""))
_TEX = ((re.compile(r"\\begin\{[a-zA-Z*]+\}.*?\\end\{[a-zA-Z*]+\}", re.S), ""), (re.compile(r"\$\$.*?\$\$|\$[^$\n]+\$"), ""), (re.compile(rf"\\(?:{TEX_COMMANDS})(?:\s*\{{[^{{}}]*\}})*"), ""), (re.compile(r"\\[a-zA-Z]+\*?"), ""), (re.compile(r"[ \t]+\n"), "\n"), (re.compile(r"\n{3,}"), "\n\n"))
#: Of lines of COMMON_LINE characters or more, a run of COMMON that both have makes their ratio COMMON_RATIO at least.
COMMON_LINE, COMMON, COMMON_RATIO = 28, 22, 0.72
#: Longest line whose common subsequences are worth their time before the matcher.
_BOUNDED = 1000


def _apply(rules: Iterable[tuple[re.Pattern, str]], s: str) -> str:
    for pattern, new in rules:
        s = pattern.sub(new, s)
    return s


class _Line:
    """A line as it is compared: case-folded, single spaces, and its words."""

    __slots__ = ("folded", "words")

    def __init__(self, s: str | None):
        words = (s or "").casefold().split()
        self.folded, self.words = " ".join(words), frozenset(words)


def _overlap(a: _Line, b: _Line) -> float:
    return len(a.words & b.words) / len(a.words | b.words)


def _similarity(a: _Line, b: _Line) -> float:
    x, y = a.folded, b.folded
    if not (x and y):
        return 0.0
    if x == y:
        return 1.0
    n, longest = matched(x, y)
    ratio = 2.0 * n / (len(x) + len(y))
    if min(len(x), len(y)) >= COMMON_LINE and ratio < COMMON_RATIO and longest >= COMMON:
        ratio = COMMON_RATIO
    return max(ratio, (ratio + _overlap(a, b)) / 2)


def line_similarity(a: str | None, b: str | None) -> float:
    """SCL5: how alike two lines are, 0 to 1. Not symmetric: the matcher's junk rule looks at the second."""
    return _similarity(_Line(a), _Line(b))


def _may_reach(a: _Line, b: _Line, n: int, least: float, run: bool) -> bool:
    """Whether two lines can be alike by ``least`` if blocks match ``n`` characters at most; ``run``: if they may have COMMON in a row."""
    ratio = 2.0 * n / (len(a.folded) + len(b.folded))
    if run:
        ratio = max(ratio, COMMON_RATIO)
    return ratio >= least or (ratio + 1) / 2 >= least and (ratio + _overlap(a, b)) / 2 >= least


def _first_alike(line: _Line, others: list[tuple[_Line, float]]) -> int:
    """The first of ``others`` that ``line`` is alike by its measure at least, -1 if there is none.

    The matcher runs only where neither the lengths nor the common subsequences rule it out.
    """
    x, left = line.folded, []
    for i, (other, least) in enumerate(others):
        y = other.folded
        if not (x and y):
            continue
        if x == y:
            left.append((i, True))
            break
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        run = len(short) >= COMMON_LINE and shares(short, long, COMMON)
        if _may_reach(line, other, len(short), least, run):
            left.append((i, run))
    if len(x) <= _BOUNDED:
        near = [(i, run) for i, run in left if len(others[i][0].folded) <= _BOUNDED and others[i][0].folded != x]
        bounds = dict(zip((i for i, _ in near), common(x, [others[i][0].folded for i, _ in near]))) if near else {}
        left = [(i, run) for i, run in left if i not in bounds or _may_reach(line, others[i][0], bounds[i], others[i][1], run)]
    return next((i for i, _ in left if _similarity(line, others[i][0]) >= others[i][1]), -1)


def merge_near_lines(text: str | None) -> str | None:
    """SCL6: of a line and a likeness among the last LOOK_BACK kept ones the longer stays, in the earlier one's place."""
    kept: list[tuple[str, int, _Line | None]] = []
    for line in (text or "").splitlines():
        n = len(line.strip())
        if not n:
            if kept and kept[-1][0] != "":
                kept.append(("", 0, None))
            continue
        own = _Line(line)
        places = [k for k in reversed(range(max(0, len(kept) - LOOK_BACK), len(kept))) if kept[k][1]]
        found = _first_alike(own, [(kept[k][2], LONG_ALIKE if max(n, kept[k][1]) >= LONG_LINE else SHORT_ALIKE) for k in places])
        if found < 0:
            kept.append((line, n, own))
        elif n > kept[places[found]][1]:
            kept[places[found]] = (line, n, own)
    while kept and not kept[-1][1]:
        del kept[-1]
    return "\n".join(x for x, _, _ in kept) if text else text


def drop_repeated_tail(text: str | None, share: float = 0.22) -> str | None:
    """SCL8, FLT10: trailing paragraphs, up to three at a time, go while their long words stand before them."""
    if not text:
        return text
    parts = re.split(r"\n\s*\n+", text.strip())
    found = [{w.casefold() for w in LONG_WORD.findall(p)} for p in parts]
    held = Counter(w for words in found for w in words)  # paragraphs that have a word

    def repeats(n: int) -> bool:
        tail = Counter(w for words in found[-n:] for w in words)
        return len(tail) >= 4 and sum(held[w] > k for w, k in tail.items()) >= max(3, share * len(tail))

    while True:
        n = next((n for n in (3, 2, 1) if n < len(parts) and repeats(n)), 0)
        if not n:
            return "\n\n".join(parts).strip()
        held.subtract(w for words in found[-n:] for w in words)
        del parts[-n:], found[-n:]


def cap_runs(text: str) -> str:
    """WIN2: of equal consecutive lines two stay."""
    lines = text.splitlines()
    return "\n".join(x for i, x in enumerate(lines) if i < 2 or not (x == lines[i - 1] == lines[i - 2]))


def collapse_loops(text: str | None) -> str | None:
    """SCL2: run cap, phrase loops, near lines, TeX, repeated tail."""
    if not text:
        return text
    return (drop_repeated_tail(_apply(_TEX, merge_near_lines(once(cap_runs(text)))).strip()) or "").strip()


def html_to_text(raw: str | None) -> str:
    """SCL1 in full: markup to lines and blocks, all entities, loops collapsed."""
    if not raw or "<" not in raw:
        return collapse_loops((raw or "").strip()) or ""
    s = "\n".join(x.strip() for x in html.unescape(_apply(_MARKUP, raw)).split("\n"))
    return collapse_loops(re.sub(r"\n{3,}", "\n\n", s).strip()) or ""


def _overlaps(above: list[str], below: list[str]) -> bool:
    """AGG9: whether lines side by side are alike, each by OVERLAP_LEAST and by OVERLAP_MEAN in the mean."""
    alike = []
    for p, q in zip(above, below):
        a, b = _Line(p), _Line(q)
        if _first_alike(a, [(b, OVERLAP_LEAST)]) < 0:
            return False
        alike.append(_similarity(a, b))
    return sum(alike) / len(alike) >= OVERLAP_MEAN


def stitch(bands: Iterable[str | None]) -> str:
    """JN2: bands in order as blocks, without the lines that a band repeats from the end of what the band before it left; then SCL1."""
    left: list[list[str]] = []
    for band in bands:
        lines = (band or "").strip().splitlines()
        before = left[-1] if left else []
        for k in range(min(MOST_OVERLAP, len(before), len(lines)), 0, -1):
            if _overlaps(before[-k:], lines[:k]):
                del lines[:k]
                break
        while lines and not lines[0].strip():
            del lines[0]
        if lines:
            left.append(lines)
    return html_to_text("\n\n".join("\n".join(x) for x in left).strip())


def prefer_refined(draft: str | None, refined: str | None) -> str | None:
    """FLT6: the refined text, unless it is blank or too short; a heading that it lost comes back from the draft."""
    d, r = draft or "", refined or ""
    if not r.strip() or len(r.split()) < max(12, int(0.45 * max(1, len(d.split())))):
        return draft
    a, b = d.splitlines(), r.splitlines()
    head = next((x for x in a if x.strip()), "")
    if not head or line_similarity(head, next(x for x in b if x.strip())) >= 0.62:
        return refined
    body = [(j, _Line(b[j])) for j in range(2, len(b)) if b[j].strip()]
    for i in range(2, len(a)):
        found = _first_alike(_Line(a[i]), [(line, 0.7) for _, line in body])
        if found >= 0:
            return "\n".join(a[:i] + b[body[found][0] :]).strip()
    return draft


def _alike() -> dict[str, str]:
    out: dict[str, set[str]] = {}
    for x, y in ALIKE:
        out.setdefault(x, set()).add(y)
        out.setdefault(y, set()).add(x)
    return {k: "".join(sorted(v)) for k, v in out.items()}


def cursive_pick(word: str, known: Callable[[str], bool] | frozenset[str], alike: Mapping[str, str] | None = None) -> str | None:
    """SCL13: the one known word that three look-alike letters away makes of ``word``; None if there is none or more than one."""
    alike = alike or _alike()
    w = word.casefold()
    test = known.__contains__ if isinstance(known, frozenset) else known
    places = [i for i, c in enumerate(w) if c in alike]
    found: set[str] = set()
    for at in combinations(places, 3):
        for new in product(*(alike[w[i]] for i in at)):
            x = list(w)
            for i, c in zip(at, new):
                x[i] = c
            if (y := "".join(x)) != w and test(y):
                found.add(y)
                if len(found) > 1:
                    return None
    return found.pop() if found else None


def _in_case(source: str, new: str) -> str:
    return new.upper() if source.isupper() else new[:1].upper() + new[1:] if source[:1].isupper() else new


def fix_cursive(text: str | None, known: frozenset[str]) -> str | None:
    """SCL12: words of five letters or more that the lexicon lacks, replaced by their only look-alike."""
    fix = lambda m: m[0] if len(m[0]) < 5 or m[0].casefold() in known or not (p := cursive_pick(m[0], known)) else _in_case(m[0], p)
    return re.sub("[А-Яа-яЁё]+", fix, text) if text else text


def spell(text: str | None, lexicon: Mapping[str, int], letters: str = "абвгдежзийклмнопрстуфхцчшщъыьэюяё") -> str | None:
    """SCL15: words of four letters or more that the lexicon lacks, replaced by the most frequent known word one edit away."""

    def best(w: str) -> str:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        edits |= {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        return max((x for x in edits if x in lexicon), key=lambda x: (lexicon[x], x), default=w)

    def fix(m: re.Match) -> str:
        w = m[0].lower()
        if len(w) < 4 or "-" in w or w in lexicon:
            return m[0]
        new = best(w)
        return m[0] if new == w or len(new) < 4 else _in_case(m[0], new)

    return re.sub("[А-Яа-яЁё-]+", fix, text) if text else text


def each(f: Callable[[str], str | float | None], kind: str = "string") -> Callable[..., Column]:
    """An Arrow UDF that applies ``f`` to each row of its columns."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns)], dtype="float64" if kind == "double" else object)

    if f.__code__.co_argcount - len(f.__defaults__ or ()) == 2:
        return F.pandas_udf(lambda a, b: run(a, b), kind, functionType=200)
    return F.pandas_udf(lambda a: run(a), kind, functionType=200)
