"""Exact token ids of public tokenizers, encoding each distinct stretch of text once per worker."""

from __future__ import annotations

import hashlib
import os
import re
import string
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept_by_worker

#: Stretches that a worker remembers, and the longest one it remembers, in characters.
MEMO, LONGEST = 1_000_000, 64
#: Bytes that a worker may fill with stretches and their counts, and what one takes beside its characters.
ROOM, ENTRY = 64_000_000, 64
#: A byte-level pre-token never runs from a character that isn't white space into ASCII white space.
BREAK = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
#: ASCII punctuation, and strings in one go of the library.
PUNCTUATION, GO = string.punctuation.encode(), 256


class _Memo(dict):
    """Ids of stretches; those that it has no room for are looked up in ``rare``."""

    def __init__(self):
        self.rare: dict = {}

    def __missing__(self, stretch):
        return self.rare[stretch]


class Encoder:
    """Token ids by the tokenizers library, without added special tokens.

    ``words``: the tokenizer drops white space before it merges, so texts fall into words at ASCII white space; otherwise
    (byte-level merges) they are cut where ASCII white space follows another character. No token of either kind crosses such a place,
    so the ids of a text are those of its stretches in turn. A word that ends in a letter and then ASCII punctuation is those two
    in turn as well, as no token holds a letter and punctuation. The first ``most`` stretches are remembered: frequent ones come
    early, so that later ones are rare.
    """

    def __init__(self, path: str, words: bool, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.most = words, most
        self.memo: _Memo = _Memo()
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = plain[0] if plain else None

    def _encoded(self, some: list[str]) -> list[bytes]:
        """The ids of each string. Strings go to the library many at a time, with a special token between them, at which it cuts."""
        if self.mark is None or any("<|" in s for s in some):
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        number, mark = self.mark
        ids = np.asarray(self.tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
        flat, ends = ids.tobytes(), (4 * np.flatnonzero(ids == number)).tolist()
        return [flat[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(flat)])]

    def _fresh(self, new: list) -> Iterator[tuple]:
        """The stretches, each with its ids."""
        sign = b"<|" if self.words else "<|"  # a special token may be inside: the cut would be ambiguous
        odd, new = [s for s in new if sign in s], [s for s in new if sign not in s]
        for some in [[s] for s in odd] + [new[i : i + GO] for i in range(0, len(new), GO)]:
            yield from zip(some, self._encoded([s.decode() for s in some] if self.words else some))

    def _learn(self, new: list) -> None:
        """Puts the ids of stretches into the memo, or into what it holds for this call only."""
        for s, ids in self._fresh(new):
            (self.memo if len(self.memo) < self.most and len(s) <= LONGEST else self.memo.rare)[s] = ids

    def _look_up(self, stretches: list) -> None:
        """Makes the memo, or ``rare``, hold each of the distinct stretches."""
        memo = self.memo
        new = [s for s in stretches if s not in memo]
        tails = {}
        if self.words:
            for w in new:
                stem = w.rstrip(PUNCTUATION)
                if stem and len(stem) < len(w) and b"<|" not in w and stem.decode()[-1].lower().isalpha():
                    tails[w] = stem, w[len(stem) :]
            apart = {x for pair in tails.values() for x in pair}.union(w for w in new if w not in tails)
            new = [x for x in apart if x not in memo]
        self._learn(new)
        for w, (stem, tail) in tails.items():
            (memo if len(memo) < self.most and len(w) <= LONGEST else memo.rare)[w] = memo[stem] + memo[tail]

    def ids(self, texts: Sequence[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        memo = self.memo
        if self.words:
            column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            # this kind lowers case itself, but for special tokens
            cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column)))
            coded = cut.values.dictionary_encode()
            words = coded.dictionary.cast(pa.large_binary()).to_pylist()
            self._look_up(words)
            known = [memo[w] for w in words]
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            code = coded.indices.to_numpy()
            each = size[code]
            upto = np.concatenate([[0], np.cumsum(each)])
            place = np.repeat((np.cumsum(size) - size)[code] - upto[:-1], each) + np.arange(upto[-1])
            flat = np.frombuffer(b"".join(known), "<u4")[place]
            ends = upto[cut.offsets.to_numpy()]
            found = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        else:
            cut = [BREAK.split(t.decode()) for t in texts]
            self._look_up(list(set().union(*cut)))
            found = [b"".join(map(memo.__getitem__, c)) for c in cut]
        memo.rare = {}
        return found


class Counter(Encoder):
    """Numbers of ids by a byte-level tokenizer.

    Of a stretch it remembers the count alone, and as many stretches as fit into ``room`` bytes: their number says little, as they
    are long in scripts without spaces. Later ones are encoded whenever they come, so ``room`` changes no count.
    """

    def __init__(self, path: str, room: int = ROOM):
        super().__init__(path, False)
        self.room = room

    def counts(self, texts: Sequence[bytes]) -> list[int]:
        """The number of ids of each text."""
        memo = self.memo
        cut = [BREAK.split(t.decode()) for t in texts]
        for s, ids in self._fresh([s for s in set().union(*cut) if s not in memo]):
            takes = sys.getsizeof(s) + ENTRY
            if takes <= self.room and len(s) <= LONGEST:
                self.room -= takes
                memo[s] = len(ids) // 4
            else:
                memo.rare[s] = len(ids) // 4
        found = [sum(map(memo.__getitem__, c)) for c in cut]
        memo.rare = {}
        return found


def encoder(path: str, words: bool, most: int = MEMO) -> Encoder:
    """This worker's encoder for the file, which remembers ``most`` stretches."""
    return kept_by_worker(("tokens", path, words, most), lambda: Encoder(path, words, most))


def counter(path: str) -> Counter:
    """This worker's counter for the file."""
    return kept_by_worker(("counts", path), lambda: Counter(path))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of what decides a text's tokens: the file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
