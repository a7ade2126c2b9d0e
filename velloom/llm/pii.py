"""Format-preserving Feistel pseudonyms for personal data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import giving_back

ROUNDS = 10
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: What may hold a value; each match is validated before anything is replaced.
PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))
    |(?P<secret>(?i:(?:token|api[_-]?key|password|passwd|secret)["']?\s{0,3}[:=]\s{0,3}["']?)(?P<value>[A-Za-z0-9_\-./+]{12,}))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w]))
    |(?P<date>(?<![\w.\-/])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![\w\-/]|\.[0-9]))
    |(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9]))
    |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|-[0-9]))""",
    re.X,
)
#: Where a match that fails may end sooner; what the search passes over when no end will do.
BREAK, TOKEN = re.compile("[ .-]+"), re.compile("[^A-Za-z0-9]*[A-Za-z0-9]+")
#: Characters of a secret that are permuted in one go.
PIECE = 128
ANY = re.compile(r"[0-9@]|(?i:token|key|passw|secret)")


class Cipher:
    """A keyed permutation of 0..n-1 for any n: a balanced Feistel network over the next even number of bits, walked until it lands below n."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, half // 8 + 1

        def f(i: int, r: int) -> int:
            h = blake2b(b"%d|%d|" % (i, n) + kind.encode() + b"|" + r.to_bytes(width, "little"), key=self.key, digest_size=min(64, width + 8))
            return int.from_bytes(h.digest(), "little") & mask

        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ f(i, a), a) if back else (b, a ^ f(i, b))
            x = a << half | b
            if x < n:
                return x

    def text(self, s: str, kind: str, back: bool = False) -> str:
        """Permutes letters and digits of ``s`` within their classes; the rest stays where it is."""
        sets = [next((a for a in (DIGITS, LETTERS, LETTERS.upper()) if c in a), c) for c in s]
        x, n = 0, 1
        for c, a in zip(s, sets):
            x, n = x * len(a) + a.index(c), n * len(a)
        x = self.permute(x, n, kind, back)
        out = []
        for a in reversed(sets):
            x, i = divmod(x, len(a))
            out.append(a[i])
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` and itself pass the Luhn test."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(s: str, c: Cipher, back: bool) -> str | None:
    d = re.sub("[ -]", "", s)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    while True:  # a pseudonym is a number that would be found again
        body = c.text(d[:-1], "card", back)
        d = body + str(luhn(body))
        if len(set(d)) > 1:
            return _refill(s, d)


def _iban(s: str, c: Cipher, back: bool) -> str | None:
    d = s.replace(" ", "")
    number = lambda x: int("".join(str(int(ch, 36)) for ch in x))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = c.text(d[4:], "iban" + d[:2], back)
    it = iter(d[:2] + f"{98 - number(body + d[:2] + '00') % 97:02d}" + body)
    return "".join(ch if ch == " " else next(it) for ch in s)


def _phone(s: str, c: Cipher, back: bool) -> str | None:
    d = re.sub("[^0-9]", "", s)
    code = re.match(r"\+([0-9]{1,3})", s)[1]
    if not 8 <= len(d) <= 15:
        return None
    north = d[0] == "1" and len(d) == 11
    keep = 1 if north else min(len(code), 2)
    fine = lambda x: not north or (x[0] > "1" and x[3] > "1")
    x = d[keep:]
    if not fine(x):
        return None
    while True:
        x = c.text(x, "phone" + d[:keep], back)
        if fine(x):
            return _refill(s, d[:keep] + x)


def _ssn(s: str, c: Cipher, back: bool) -> str | None:
    fine = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    x = s.replace("-", "")
    if not fine(x):
        return None
    while True:
        x = c.text(x, "ssn", back)
        if fine(x):
            return _refill(s, x)


def _ip(s: str, c: Cipher, back: bool) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    return ".".join(map(str, c.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip", back).to_bytes(4, "big")))


def _date(s: str, c: Cipher, back: bool) -> str | None:
    parts = re.split("[-/.]", s)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    for o in (order, (2, 0, 1)):  # day before month, where that is a date
        if len(parts[o[0]]) != 4:
            continue
        try:
            n = date(*(int(parts[i]) for i in o)).toordinal()
        except ValueError:
            continue
        if FIRST <= n <= LAST:
            while True:
                n = FIRST + c.permute(n - FIRST, LAST - FIRST + 1, "date", back)
                d = date.fromordinal(n)
                if o != (2, 0, 1) or d.day > 12:  # else it would be read back the other way round
                    break
            out = list(parts)
            for i, v in zip(o, (d.year, d.month, d.day)):
                out[i] = str(v).zfill(4 if i == o[0] else 2)
            seps = re.findall("[-/.]", s)
            return out[0] + seps[0] + out[1] + seps[1] + out[2]
    return None


def _email(s: str, c: Cipher, back: bool) -> str | None:
    local, host = s.split("@")
    labels = host.split(".")
    plain = local + "@" + labels[0]
    x = c.text(plain.lower(), "email", back)  # one address in any case is one value; its capitals stay where they are
    return "".join(new.upper() if old.isupper() else new for old, new in zip(plain, x)) + "." + ".".join(labels[1:])


def _secret(s: str, c: Cipher, back: bool) -> str | None:
    return "".join(c.text(s[i : i + PIECE], f"secret{i or ''}", back) for i in range(0, len(s), PIECE))


KINDS: dict[str, Callable[[str, Cipher, bool], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}


def _values(text: str, cipher: Cipher, back: bool) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, stop, pseudonym) of each value.

    A match that fails is tried again up to each separator in it, longest first; when none will do, the search goes on one token later.
    """
    at = 0
    while m := PATTERN.search(text, at):
        at = TOKEN.match(text, m.start()).end()
        for end in [m.end(), *reversed([x.start() for x in BREAK.finditer(text, m.start() + 1, m.end())])]:
            s = m if end == m.end() else PATTERN.match(text, m.start(), end)
            if not s or s.end() != end:
                continue
            kind = "secret" if s["value"] else s.lastgroup
            a, b = s.span("value") if s["value"] else s.span()
            new = KINDS[kind](text[a:b], cipher, back)
            if new is not None:
                yield kind, a, b, new
                at = end
                break


def pseudonymise(text: str, cipher: Cipher, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where they stand in it: kind, start, stop."""
    if not ANY.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    for kind, a, b, new in _values(text, cipher, back):
        out += [text[at:a], new]
        size += a - at
        spans.append({"kind": kind, "start": size, "stop": size + len(new)})
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "spans") -> DataFrame:
    """``docs`` with pseudonyms in place of personal data in ``text_col``, and ``spans_col`` (kind, start, stop) last.

    Where ``docs`` has a column of that name, underscores are added to it until it is a new one.

    Found and validated: cards (Luhn), IBANs (modulo 97), phone numbers (+ and country code), US social security numbers, IPv4
    addresses, dates from 1900 to 2099, email addresses, labelled secrets. Each is permuted by a keyed Feistel network among the
    values of its own format, so that separators, length and check digits hold, equal values have equal pseudonyms in all documents,
    different ones different ones, and the key alone leads back. A date written with one digit for day or month gets two. Where a value
    has digits beside it, its pseudonym may read as valid together with them; then the way back needs the spans as well.

    A null text stays null with no spans; empty texts, repeated rows, null ids and all other columns pass through; an empty table gives
    an empty result. Work is row by row: nothing is shuffled.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    where = names.index(text_col)
    plain = docs.toDF(*inner)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise(t, cipher) for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array([t for t, _ in done], pa.string())
            yield pa.record_batch([*columns, pa.array([s for _, s in done], kinds)], names=[*inner, "spans"])

    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("stop", LongType())])
    found = plain.mapInArrow(giving_back(run), StructType([*(StructField(f.name, f.dataType) for f in plain.schema.fields), StructField("spans", ArrayType(span))]))
    while spans_col in names:
        spans_col += "_"
    return found.toDF(*names, spans_col) if spans_col else found.drop("spans").toDF(*names)


#: The queries' key. A deployment passes its own.
KEY = b"velloom example key"


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Query: all documents with pseudonyms in place of personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonyms(docs, KEY).select("doc_id", "text", F.size("spans").alias("n_found"), "spans")
