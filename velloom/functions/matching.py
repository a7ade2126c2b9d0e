"""difflib's ratio and the phrase-loop pattern with the same results in less time: bits of whole numbers and array filters for loops over characters."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import numpy as np

#: Fixed values of the standard matcher: length from which frequent characters of the second text start no match.
JUNK_FROM = 200
#: Fixed values of the phrase loop: shortest and longest phrase.
LEAST_PHRASE, MOST_PHRASE = 12, 160
LOOP = re.compile(rf"(.{{{LEAST_PHRASE},{MOST_PHRASE}}}?)(?:\s*\1){{2,}}", re.S)
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
#: Characters of a text whose periods are looked for at once.
_PIECE = 4096


def _masks(text: str, skip: Iterable[str] = ()) -> dict[str, int]:
    """Bit j of a character's number is set where the text has it at place j."""
    found: dict[str, int] = {}
    bit = 1
    for c in text:
        found[c] = found.get(c, 0) | bit
        bit <<= 1
    for c in skip:
        del found[c]
    return found


def _same_start(a: str, b: str) -> int:
    """The length of the common start of two texts."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _dense(a: str, b: str, masks: dict[str, int]) -> tuple[int, int]:
    """``matched`` where each character counts. A table of a's characters by b's lies in one number, row by row, so that a run along a
    diagonal is found by shifts; the lowest bit of the longest runs is the earliest in a, then in b, as the standard matcher has it."""
    wide = len(b) + 1  # a column of zeros parts the rows
    size = -(-wide // 8)
    wide = 8 * size
    rows = {c: m.to_bytes(size, "little") for c, m in masks.items()}
    none = bytes(size)
    table = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    ones = int.from_bytes((b"\1" + bytes(size - 1)) * len(a), "little")
    step, total, first = wide + 1, 0, -1
    todo = [(table, len(a), len(b))]
    while todo:
        table, h, w = todo.pop()
        runs, n = [table], 1
        while more := runs[-1] & (runs[-1] >> n * step):
            runs.append(more)
            n *= 2
        longest, s = runs.pop(), n
        while runs:
            s //= 2
            if more := longest & (runs.pop() >> n * step):
                longest, n = more, n + s
        if first < 0:
            first = n
        total += n
        i, j = divmod((longest & -longest).bit_length() - 1, wide)
        if i and j:
            unit = ones & ((1 << i * wide) - 1)
            if part := table & ((unit << j) - unit):
                todo.append((part, i, j))
        i, j = i + n, j + n
        if i < h and j < w:
            unit = ones & ((1 << (h - i) * wide) - 1)
            if part := (table >> i * wide + j) & ((unit << w - j) - unit):
                todo.append((part, h - i, w - j))
    return total, first


def _sparse(a: str, b: str, places: dict[str, list[int]]) -> tuple[int, int]:
    """``matched`` where only characters in ``places`` start a match, and all lengthen it."""
    rows = [i for i, c in enumerate(a) if c in places]
    at = [places[a[i]] for i in rows]
    total, first = 0, -1
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        besti, bestj, best = alo, blo, 0
        before: dict[int, int] = {}
        last = -2
        for r in range(bisect_left(rows, alo), bisect_left(rows, ahi)):
            i = rows[r]
            if i != last + 1:
                before = {}
            last = i
            now: dict[int, int] = {}
            found = at[r]
            for j in found if len(found) < 8 else found[bisect_left(found, blo) :]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = now[j] = before.get(j - 1, 0) + 1
                if k > best:
                    besti, bestj, best = i - k + 1, j - k + 1, k
            before = now
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, best = besti - 1, bestj - 1, best + 1
        if besti + best < ahi and bestj + best < bhi and a[besti + best] == b[bestj + best]:
            best += _same_start(a[besti + best : ahi], b[bestj + best : bhi])
        if first < 0:
            first = best
        if best:
            total += best
            if alo < besti and blo < bestj:
                todo.append((alo, besti, blo, bestj))
            if besti + best < ahi and bestj + best < bhi:
                todo.append((besti + best, ahi, bestj + best, bhi))
    return total, first


def matched(a: str, b: str) -> tuple[int, int]:
    """What ``SequenceMatcher(None, a, b)`` counts: characters in its matching blocks, and the size of the longest match."""
    if not (a and b):
        return 0, 0
    if len(b) < JUNK_FROM:
        masks = _masks(b)
        if not any(c in masks for c in a):
            return 0, 0
        return _dense(a, b, masks)
    places: dict[str, list[int]] = {}
    for c, n in Counter(b).items():
        if n <= len(b) // 100 + 1:
            places[c] = []
    for j, c in enumerate(b):
        if c in places:
            places[c].append(j)
    return _sparse(a, b, places)


def common(a: str, others: list[str]) -> list[int]:
    """The length of the longest common subsequence of ``a`` and each other text, all in one pass over ``a`` (bits of one number, a zero
    between texts that takes up the carry). No matcher finds more characters in blocks that follow each other in both."""
    masks: dict[str, int] = {}
    whole, at = 0, 0
    for o in others:
        for c, m in _masks(o).items():
            masks[c] = masks.get(c, 0) | m << at
        whole |= ((1 << len(o)) - 1) << at
        at += len(o) + 1
    v = whole
    get = masks.get
    for c in a:
        if m := get(c):
            x = v & m
            v = (v + x | v ^ x) & whole
    found = []
    for o in others:
        found.append(len(o) - (v & ((1 << len(o)) - 1)).bit_count())
        v >>= len(o) + 1
    return found


def shares(x: str, y: str, n: int) -> bool:
    """Whether ``x`` may hold ``n`` characters in a row that ``y`` holds; False is sure."""
    k = (n + 1) // 2
    return any(x[i : i + k] in y for i in range(0, len(x) - k + 1, k))


def _starts(s: str) -> np.ndarray:
    """Places where LOOP may match, none of its matches left out.

    Without white space a phrase of l characters that stands three times is a run of 2 l characters equal to the one l further on. A
    run of 15 holds eight such at a place divisible by 8. Phrases of less than 8 need 12 places with five blanks among them.
    """
    u = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _SPACE[np.minimum(u, len(_SPACE) - 1)]
    black = ~blank
    t = u[black]
    n = len(t)
    hit = np.zeros(n + 1, bool)
    small = np.concatenate([(t ^ t >> 8).astype(np.uint8), np.zeros(MOST_PHRASE, np.uint8)])
    full = np.uint64(0x0101010101010101)
    lengths: set[int] = set()
    for a in range(0, n, _PIECE):
        m = min(_PIECE, n - a)
        ahead = np.lib.stride_tricks.as_strided(small[a + 8 :], (MOST_PHRASE - 7, m), (1, 1))
        same = np.zeros((MOST_PHRASE - 7, -(-m // 8) * 8), bool)
        np.equal(small[a : a + m], ahead, out=same[:, :m])
        lengths.update((np.flatnonzero((same.view(np.uint64) == full).any(axis=1)) + 8).tolist())
    gaps = np.concatenate([[0], np.cumsum(blank, dtype=np.int64)])
    dense = gaps[LEAST_PHRASE:] - gaps[:-LEAST_PHRASE] > LEAST_PHRASE - 8
    if dense.any():
        lengths.update(range(1, 8))
    for size in lengths:
        if n >= 3 * size:
            odd = np.concatenate([[0], np.cumsum(t[:-size] != t[size:])])
            hit[: n - 3 * size + 1] |= odd[2 * size :] == odd[: n - 3 * size + 1]
    found = hit[np.arange(len(s)) - gaps[:-1]]
    wide = 3 * LEAST_PHRASE
    if dense.any() and len(s) >= wide:
        found[: len(s) - wide + 1] |= gaps[wide:] - gaps[:-wide] == wide
    return np.flatnonzero(found)


def once(s: str) -> str:
    """``LOOP.sub(r"\\1", s)``, tried only where it may match."""
    if len(s) < 3 * LEAST_PHRASE:
        return s
    out, done = [], 0
    for i in _starts(s).tolist():
        if i >= done and (m := LOOP.match(s, i)):
            out += [s[done:i], m[1]]
            done = m.end()
    return "".join([*out, s[done:]]) if out else s
