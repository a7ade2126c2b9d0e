"""Toxicity by class-conditional Kneser-Ney models of characters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import giving_back, saved, utf8

#: Characters of an n-gram; discount of counts; weight of the order below in every context, in counts (corpus, classes).
ORDER, DISCOUNT, CORPUS_PRIOR, CLASS_PRIOR = 5, 0.75, 1e-3, 1.0
#: Labelled texts of each class that are learnt from at most (those with the least hash of doc_id), and their bytes in all.
LABELLED, LABELLED_BYTES = 8000, 32_000_000
#: Characters taken in one go; different n-grams that a task holds before it hands them on.
PIECE, HELD = 500_000, 300_000
#: Words, in pieces of 40 characters where they are longer.
WORD, GAP = re.compile(r"\w{1,40}"), re.compile(r"\W")
#: Characters that stand before a text.
FRONT = " " * (ORDER - 1)
_MIX = 0x9E3779B97F4A7C15


def parts(data: bytes) -> Iterator[str]:
    """A text as the models read it: its lower-case words with a space after each, in parts of about PIECE characters.

    Each part begins with the ORDER - 1 characters before it, the first with FRONT. A text without words has no part.
    """
    text, at, front = data.decode(), 0, FRONT
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.start() if gap else len(text)
        found = WORD.findall(text[at:end].lower())
        if found:
            part = f"{front}{' '.join(found)} "
            yield part
            front = part[1 - ORDER :]
        at = end


def pieces(some: Iterator[str]) -> Iterator[list[str]]:
    """Parts in lists of about PIECE characters."""
    held, size = [], 0
    for part in some:
        held.append(part)
        size += len(part)
        if size > PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def windows(ids: np.ndarray, base: int) -> np.ndarray:
    """The number of the ORDER symbols up to each place from ORDER - 1 on, in base ``base`` modulo 2 ** 64."""
    n, base = len(ids) - ORDER + 1, np.uint64(base)
    out = ids[:n].astype(np.uint64)
    for k in range(1, ORDER):
        out *= base
        out += ids[k : k + n]
    return out


def places(texts: list[str]) -> np.ndarray:
    """For each window of the joined texts whether it lies within one of them."""
    fine = np.ones(sum(map(len, texts)) - ORDER + 1, bool)
    for end in np.cumsum([len(t) for t in texts])[:-1]:
        fine[end - ORDER + 1 : end] = False
    return fine


def tally(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The different n-grams of ORDER characters within the texts, none of which is empty, and how often each occurs."""
    code = code_points(texts)
    mark = np.zeros(int(code.max()) + 1, bool)
    mark[code] = True
    alphabet = np.flatnonzero(mark).astype(np.uint32)
    if len(alphabet) ** ORDER < 1 << 64:
        rank = np.zeros(len(mark), np.uint64)
        rank[alphabet] = np.arange(len(alphabet))
        found, n = np.unique(windows(rank[code], len(alphabet))[places(texts)], return_counts=True)
        digits = np.empty((len(found), ORDER), np.uint32)
        for k in reversed(range(ORDER)):
            found, digit = np.divmod(found, np.uint64(len(alphabet)))
            digits[:, k] = alphabet[digit]
    else:
        cut = np.lib.stride_tricks.sliding_window_view(code, ORDER)[places(texts)]
        digits, n = np.unique(np.ascontiguousarray(cut).view(f"<U{ORDER}")[:, 0], return_counts=True)
    return np.ascontiguousarray(digits).view(f"<U{ORDER}").reshape(-1).tolist(), n


def corpus_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram): the different n-grams of ORDER characters of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        done = lambda: pa.record_batch([pa.array(list(held), pa.string())], names=["gram"])
        for some in pieces(p for batch in batches for x in utf8(batch.column(0)) for p in parts(x)):
            held.update(tally(some)[0])
            if len(held) > HELD:
                yield done()
                held = set()
        if held:
            yield done()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(giving_back(run), "gram string").distinct()


def orders(grams: DataFrame) -> list[DataFrame]:
    """(gram, n) for 1..ORDER-1 characters from the different n-grams of ORDER: how many different ones a character longer end in it."""
    counted = []
    for k in reversed(range(1, ORDER)):
        grams = saved(grams.groupBy(F.right("gram", F.lit(k)).alias("shorter")).agg(F.count("*").alias("n")).withColumnRenamed("shorter", "gram"))
        counted.append(grams)
    return counted[::-1]


def known(wanted: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """(gram, n, total, taken) for each of ``wanted``: its count, its context's, and what the discount takes from the context; null for none."""
    context = F.substring("gram", 1, k - 1).alias("context")
    sums = counted.groupBy(context).agg(F.sum("n").alias("total"), F.sum(F.least("n", F.lit(DISCOUNT))).alias("taken"))
    found = wanted.select("gram", context).join(counted.select("gram", "n"), "gram", "left").join(sums, "context", "left")
    return found.select("gram", F.col("n").cast("double").alias("n"), F.col("total").cast("double").alias("total"), F.col("taken").cast("double").alias("taken"))


def discounted(n: float | None, total: float | None, taken: float | None, prior: float) -> tuple[float, float]:
    """An n-gram's own discounted share in its context, and what is left there for the order below."""
    if total is None:
        return 0.0, 1.0
    return max((n or 0.0) - DISCOUNT, 0.0) / (total + prior), (taken + prior) / (total + prior)


class Table:
    """Numbers of n-grams: ``ratio`` of those learnt, and by context for all others; 0 where neither is known.

    An n-gram is known by its characters' ranks as one number. That is exact up to 7131 different characters; beyond, the number is
    taken modulo 2 ** 64 with a base under which the learnt ones differ.
    """

    def __init__(self, grams: dict[str, float], contexts: dict[str, float]):
        self.alphabet = sorted(set("".join(grams)) | {" "})
        self.base = len(self.alphabet) + 1
        if self.base**ORDER >= 1 << 64:
            self.base = _MIX
        while True:
            self.grams, self.contexts = self._index(grams, ORDER), self._index(contexts, ORDER - 1)
            if len(np.unique(self.grams[0])) == len(grams) and len(np.unique(self.contexts[0])) == len(contexts):
                break
            self.base += 2

    def _index(self, numbers: dict[str, float], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes and numbers by slot, each slot's start, and the bits of a slot."""
        ids = np.searchsorted(np.array([ord(c) for c in self.alphabet], np.uint32), code_points(list(numbers))) if numbers else np.empty(0)
        code = np.zeros(len(numbers), np.uint64)
        for k in range(length):
            code = code * np.uint64(self.base) + (ids.reshape(-1, length)[:, k].astype(np.uint64) + np.uint64(1))
        bits = max(4, (2 * len(code)).bit_length())
        slot = (code * np.uint64(_MIX)) >> np.uint64(64 - bits)
        order = np.argsort(slot, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(slot.astype(np.int64), minlength=1 << bits))]).astype(np.int32)
        return code[order], np.fromiter(numbers.values(), np.float64, len(code))[order], start, bits

    @staticmethod
    def _find(index: tuple, wanted: np.ndarray, out: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Puts the numbers of ``wanted`` into ``out`` (at ``at``) and returns the places in ``out`` of those not found."""
        code, number, start, bits = index
        slot = ((wanted * np.uint64(_MIX)) >> np.uint64(64 - bits)).astype(np.int64)
        now, end = start[slot], start[slot + 1]
        left = np.arange(len(out)) if at is None else at
        missing = []
        while len(left):
            full = now < end
            missing.append(left[~full])
            left, now, end, wanted = left[full], now[full], end[full], wanted[full]
            hit = code[now] == wanted
            out[left[hit]] = number[now[hit]]
            miss = ~hit
            left, now, end, wanted = left[miss], now[miss] + 1, end[miss], wanted[miss]
        return np.concatenate(missing) if missing else left

    def rank(self) -> np.ndarray:
        """Each character's rank from 1, 0 for characters that were not learnt."""
        rank = np.zeros(0x110000, np.uint64)
        rank[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return rank

    def ratios(self, points: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of the n-gram that ends at each place of a string, given by its code points; 0 for the first ORDER - 1 places."""
        ids = rank[points]
        code, out = windows(ids, self.base), np.zeros(len(ids))
        inner = out[ORDER - 1 :]
        rest = self._find(self.grams, code, inner, None)
        context = np.zeros(len(rest), np.uint64)
        for k in range(ORDER - 1):
            context = context * np.uint64(self.base) + ids[rest + k]
        self._find(self.contexts, context, inner, rest)
        return out


def measures(texts: Iterable[bytes], table: Table, rank: np.ndarray) -> np.ndarray:
    """f0..f2 of each text: its log-likelihood ratio a character, the ratio a word over the highest thirtieth of its words (one at
    least), and the logarithm of words + 1. A text without words has zeros."""
    words: list[list[np.ndarray]] = []
    length: list[int] = []
    held: list[tuple[int, str]] = []

    def done() -> None:
        points = code_points([p for _, p in held])
        ratio, ends, start = table.ratios(points, rank), points == 32, 0
        for i, p in held:
            first, start = start + ORDER - 1, start + len(p)
            last = np.flatnonzero(ends[first:start])
            words[i].append(np.add.reduceat(ratio[first:start], np.concatenate([[0], last[:-1] + 1])))
            length[i] += start - first

    size = 0
    for i, text in enumerate(texts):
        words.append([])
        length.append(0)
        for p in parts(text):
            held.append((i, p))
            size += len(p)
            if size > PIECE:
                done()
                held, size = [], 0
    if held:
        done()
    out = np.zeros((len(words), 3))
    for i, of in enumerate(words):
        if of:
            word = of[0] if len(of) == 1 else np.concatenate(of)
            top = max(1, len(word) // 30)
            out[i] = word.sum() / length[i], np.partition(word, -top)[-top:].mean(), np.log1p(len(word))
    return out


@dataclass
class Learnt:
    """What scores a text: the log-likelihood ratios of n-grams, and the weights of its measures (None where a class was never seen)."""

    table: Table | None
    weights: list[float] | None


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[float]:
    """Mean, deviation and coefficients of a logistic regression, each class weighted as given; Newton steps, a small ridge."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    weight = weights[y] * len(y) / weights[y].sum()
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.1 * b * (np.arange(len(b)) > 0)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(np.full(len(b), 0.1))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return [*mean, *std, *b]


def rising(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[float]:
    """``logistic`` in which a higher ratio, of the text or of its highest words, never lowers the probability: a ratio whose
    coefficient would be negative is left out, the most negative first."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y, weights)
        n = len(used)
        low = min((k for k in range(n) if used[k] < x.shape[1] - 1), key=lambda k: w[2 * n + 1 + k], default=None)
        if low is None or w[2 * n + 1 + low] >= 0:
            break
        del used[low]
    out = np.array([0.0] * x.shape[1] + [1.0] * x.shape[1] + [w[2 * n]] + [0.0] * x.shape[1])
    for k, i in enumerate(used):
        out[[i, x.shape[1] + i, 2 * x.shape[1] + 1 + i]] = w[k], w[n + k], w[2 * n + 1 + k]
    return out.tolist()


def probability(x: np.ndarray, weights: list[float]) -> np.ndarray:
    k = x.shape[1]
    z = (x - np.array(weights[:k])) / np.array(weights[k : 2 * k])
    return 1 / (1 + np.exp(-np.clip(weights[2 * k] + z @ np.array(weights[2 * k + 1 :]), -60, 60)))


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def class_ratios(counted: DataFrame, grams: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Logarithms of toxic over ordinary probability, of n-grams and of contexts.

    ``counted`` has y, gram, n of the classes' n-grams, ``grams`` the different n-grams of the whole corpus. Each class holds its own
    discounted counts of ORDER characters; what the discount takes goes to the orders below, down to a uniform choice among all
    characters. Their Kneser-Ney continuation counts come from the corpus, exact for each n-gram, and are shared. So where neither
    class has seen an n-gram, the shared probability cancels and its context alone decides: the n-grams of the labelled texts are all
    that scoring needs, however large the corpus; only their counts come to the driver.
    """
    wanted, lower = saved(counted.select("gram").distinct()), orders(grams)
    characters = max(1, lower[0].count())
    asked = [(wanted.select(F.right("gram", F.lit(k)).alias("gram")).distinct(), table, k) for k, table in enumerate(lower, 1)]
    asked += [(wanted, counted.where(F.col("y") == y).select("gram", "n"), ORDER) for y in (0, 1)]
    every = [known(*x).withColumn("table", F.lit(i)) for i, x in enumerate(asked)]
    union = every[0]
    for x in every[1:]:
        union = union.unionByName(x)
    found = union.toArrow()

    def numbers(i: int, prior: float) -> Iterator[tuple[str, float, float]]:
        some = found.filter(pc.equal(found["table"], i))
        for batch in some.to_batches(max_chunksize=65_536):
            for gram, *x in zip(*(batch.column(c).to_pylist() for c in ("gram", "n", "total", "taken"))):
                yield gram, *discounted(*x, prior)

    share = {"": 1 / characters}
    for i in range(ORDER - 1):
        share = {gram: own + below * share[gram[1:]] for gram, own, below in numbers(i, CORPUS_PRIOR)}
    ordinary = {gram: (own, below) for gram, own, below in numbers(ORDER - 1, CLASS_PRIOR)}
    ratio, contexts = {}, {}
    for gram, own1, below1 in numbers(ORDER, CLASS_PRIOR):
        own0, below0 = ordinary[gram]
        p = share[gram[1:]]
        ratio[gram] = log((own1 + below1 * p) / (own0 + below0 * p))
        contexts[gram[:-1]] = log(below1 / below0)
    return ratio, contexts


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, labelled_bytes: int = LABELLED_BYTES) -> Learnt:
    """A model learnt from at most ``labelled`` texts of each class outside the held-out fifth, and from all whole texts of ``docs``.

    The labelled texts are those with the least hashes, whole, up to ``labelled_bytes`` a class; that bounds the table which goes to
    the driver and to every executor: it has one row for each different n-gram in them. The shared counts come from every text.

    Three quarters of the labelled texts give the class counts, a quarter the weights that turn measures into a probability. Rows
    without a text or a label of 0 or 1 teach nothing; a doc_id labelled twice counts with its higher label; without any text of one
    class the probability is a half for all. The weights follow the classes' shares among all labels outside the held-out fifth.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("id")))
    number = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    sample = marks.select("id", "y", F.xxhash64("id").alias("h"))
    sample = sample.where("y = 1").orderBy("h").limit(labelled).union(sample.where("y = 0").orderBy("h").limit(labelled))
    picked = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = saved(picked.join(F.broadcast(sample), F.col("doc") == F.col("id")).select("y", "h", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("t")))
    before = Window.partitionBy("y").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0)
    sizes = texts.groupBy("y", "h", "t").agg(F.min("size").alias("size"))
    # at most 2 * labelled rows of hashes and sizes
    sizes = sizes.where("y = 1").orderBy("h", "t").limit(labelled).union(sizes.where("y = 0").orderBy("h", "t").limit(labelled))
    taken = sizes.withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= labelled_bytes).select("y", "h", "t")
    texts = texts.join(F.broadcast(taken), ["y", "h", "t"], "left_semi").dropDuplicates(["y", "h", "t"]).select("y", "h", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for batch in batches:
            ys, texts_ = batch.column(0).to_pylist(), list(utf8(batch.column(1)))
            for y, c in part.items():
                for piece in pieces(p for z, x in zip(ys, texts_) if z == y for p in parts(x)):
                    grams, n = tally(piece)
                    c.update(dict(zip(grams, n.tolist())))
        for y, c in part.items():
            yield pa.record_batch([pa.array([y] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["y", "gram", "n"])

    counts = texts.where("pmod(h, 4) > 0").select("y", "text").mapInArrow(giving_back(count), "y int, gram string, n long")
    counted = saved(counts.groupBy("y", "gram").agg(F.sum("n").alias("n")))
    # both classes weigh alike: equal totals, so that what neither has seen often says nothing
    sums = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(sums) < 2:
        return Learnt(None, None)
    weighed = counted.select("y", "gram", (F.col("n") * F.when(F.col("y") == 0, min(sums.values()) / sums[0]).otherwise(min(sums.values()) / sums[1])).alias("n"))
    table = Table(*class_ratios(weighed, saved(corpus_grams(docs, text_col))))
    fit = measured(texts.where("pmod(h, 4) = 0").select("y", "text"), "text", table).toPandas().sort_values(["c0", "f0", "f1", "f2"])
    weights = None
    if fit["c0"].nunique() == 2:
        weights = rising(fit[["f0", "f1", "f2"]].to_numpy(), fit["c0"].to_numpy(), np.array([number[y] / (fit["c0"] == y).sum() for y in (0, 1)]))
    return Learnt(table, weights)


def measured(rows: DataFrame, text_col: str, table: Table) -> DataFrame:
    """The columns of ``rows`` as c0, c1, ... and f0..f2 of each whole text. Row by row: nothing is shuffled."""
    inner = [f"c{i}" for i in range(len(rows.columns))]
    plain, where = rows.toDF(*inner), rows.columns.index(text_col)
    names = [*inner, "f0", "f1", "f2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = table.rank()
        for batch in batches:
            x = measures(utf8(batch.column(where)), table, rank)
            yield pa.record_batch([*batch.columns, *(pa.array(c) for c in np.ascontiguousarray(x.T))], names=names)

    added = [StructField(n, DoubleType()) for n in names[-3:]]
    return plain.mapInArrow(giving_back(run), StructType([StructField(f.name, f.dataType) for f in plain.schema.fields] + added))


def score(docs: DataFrame, model: Learnt, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score in 0..1 and predicted for every row, from its whole text alone; ``keep`` names columns to pass on.

    A null text is an empty one; an empty text, or one without words, gets the probability of measures that are all 0; repeated rows
    score alike; a null doc_id is kept; an empty table gives an empty result; columns that aren't named are left out.
    """
    weights, keep = model.weights, keep or []
    picked = docs.select(F.col(id_col).cast(LongType()), *[F.col(c) for c in keep], F.col(text_col)).toDF("doc_id", *[f"k{i}" for i in range(len(keep))], "text")
    if weights:
        k = len(weights) // 3
        done = measured(picked, "text", model.table)
        z = F.lit(weights[2 * k])
        for i in range(k):
            z = z + (F.col(f"f{i}") - weights[i]) / weights[k + i] * weights[2 * k + 1 + i]
        scored = done.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))))
    else:
        scored = picked.toDF(*[f"c{i}" for i in range(len(keep) + 2)]).withColumn("score", F.lit(0.5))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep, 1)]
    return scored.select(F.col("c0").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *kept)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: a toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
