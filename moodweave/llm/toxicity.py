"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary documents, spell out words symbol by symbol (UTF-8 bytes between a begin and an end mark,
contexts of up to ORDER - 1 symbols, never across words).  The higher orders keep counts of their own class; from SHARED_ORDER
down both classes back off to the same continuation counts, so an expression that either class saw rarely is smoothed by what
both know, and words of a family known to be toxic count even in forms never seen.  A document's score is its toxic minus its
ordinary log-likelihood over its number of words, put on a probability scale by a logistic fit on training rows that the counts
did not see.

The two interpolated models are kept as one exact table of log ratios in back-off form, as large as the sample has distinct grams,
so what executors get is bounded by the sample however large the corpus is.  Labels enter through a sample of at most
`most_rows` / 2 labelled rows of each class, those with the lowest seeded hashes; every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import short_reads, small_batches

ORDER = 5
SHARED_ORDER = 3
#: Bounds of the discounts, which each order and class estimates from its own counts of one and two.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 1.0
#: How far the estimates may be moved to 1, where a gram of one document only is no evidence; rows that the counts did not see choose.
#: The estimate takes occurrences for independent, but those of one document belong together.
TOWARD_ONE = (0.0, 0.5, 1.0)
MOST_ROWS = 40_000
THRESHOLD = 0.3
_BEGIN, _END = 1, 2


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words laid end to end, each between marks, and for each symbol its distance from its word's begin mark."""
    size = ends - starts + 2
    off = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(off[-1]) - np.repeat(off[:-1], size)
    out = tc.LOWER[data[np.minimum(np.repeat(starts, size) + place - 1, len(data) - 1)]].astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    out[off[:-1]], out[off[1:] - 1] = _BEGIN, _END
    return out, place


def maximal_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The longest gram that ends at each symbol after a begin mark."""
    symbols, place = _symbols(data, starts, ends)
    key = symbols.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(key)
        shifted[back:] = symbols[:-back] << np.uint64(8 * back)
        key |= np.where(place >= back, shifted, np.uint64(0))
    return key[place > 0]


class Table:
    """Distinct packed grams, found by their scrambled (bijective, hence exact) values: in buckets by the leading bits, in order within."""

    def __init__(self, keys: np.ndarray):
        """Also sets `order`, which sorts what belongs to the keys as they are kept."""
        h = tc.mix(keys)
        self.order = np.argsort(h)
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((h >> self.shift).astype(np.int64), minlength=1 << bits)
        self.longest = int(sizes.max())
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        self.hashes = np.append(h[self.order], np.zeros(self.longest, np.uint64))  # no gram is 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        h = tc.mix(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        out = np.full(len(keys), -1, np.int32)
        for step in range(self.longest):
            out = np.where(self.hashes[at + step] == h, at + step, out)
        return out


@dataclass
class Model:
    table: Table  # grams, and contexts of longer ones
    ratio: np.ndarray  # log ratio of a gram's probabilities; NaN for what is a context only
    backoff: np.ndarray  # log ratio of the weights a context passes on
    a: float = 1.0
    b: float = 0.0

    def word_ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        symbols, place = _symbols(data, starts, ends)
        total = np.zeros(len(symbols))
        open_ = place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if len(at):
                key = symbols[at]
                for back in range(1, n):
                    key |= symbols[at - back] << np.uint64(8 * back)
                found = self.table.find(key)
                ratio = np.where(found >= 0, self.ratio[found], np.nan)
                known = ~np.isnan(ratio)
                total[at[known]] += ratio[known]
                open_[at[known]] = False
                rest = at[~known]
                if n > 1 and len(rest):
                    context = self.table.find(key[~known] >> np.uint64(8))
                    total[rest] += np.where(context >= 0, self.backoff[context], 0)
        off = np.concatenate([[0], np.cumsum(ends - starts + 2)])
        sums = np.concatenate([[0.0], np.cumsum(total)])
        return sums[off[1:]] - sums[off[:-1]]

    def means(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log-likelihood difference per word of each document; 0 for documents without words."""
        starts, ends, woff = tc.words(data, off, tc.ALNUM)
        if not len(starts):
            return np.zeros(len(off) - 1)
        _, first, which = np.unique(tc.span_hashes(tc.LOWER[data], starts, ends), return_index=True, return_inverse=True)
        each = self.word_ratios(data, starts[first], ends[first])[which]
        sums = np.concatenate([[0.0], np.cumsum(each)])
        return (sums[woff[1:]] - sums[woff[:-1]]) / np.maximum(np.diff(woff), 1)

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * mean + self.b, -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal grams by class, of the distinct words of each document: a document that repeats a word says no more than one that has it."""
    for batch in batches:
        cls = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, end, data, off in tc.blocks(batch.column("text"), 4 << 20):
            starts, ends, woff = tc.words(data, off, tc.ALNUM)
            doc = np.repeat(np.arange(end - first), np.diff(woff))
            word = tc.mix(tc.span_hashes(tc.LOWER[data], starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            once = np.sort(np.unique(word, return_index=True)[1])  # a word counts once a document
            starts, ends, of = starts[once], ends[once], cls[first:end][doc[once]]
            for c in (0, 1):
                key, n = np.unique(maximal_grams(data, starts[of == c], ends[of == c]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), c, np.int32)), pa.array(n)], names=["gram", "cls", "n"])


def discounts(counts: np.ndarray, toward_one: float = 0.0) -> np.ndarray:
    """For each row of counts n1 / (n1 + 2 n2), n1 and n2 being how many are one and two, within the bounds, moved towards 1."""
    ones, twos = (counts == 1).sum(1), (counts == 2).sum(1)
    estimate = np.clip(ones / np.maximum(ones + 2 * twos, 1), LEAST_DISCOUNT, MOST_DISCOUNT)
    return estimate + toward_one * (1 - estimate)


def levels(gram: np.ndarray, cls: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order: the grams in ascending order and their counts by class.  Below ORDER a gram counts the distinct symbols before it,
    or, after a begin mark, how often it stands there."""
    keys, which = np.unique(gram.view(np.uint64), return_inverse=True)
    count = np.zeros((2, len(keys)))
    np.add.at(count, (cls, which), n)
    length = sum(((keys >> np.uint64(8 * i)) > 0).astype(int) for i in range(ORDER))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for order in range(ORDER, 0, -1):
        own = length == order
        k, c = [keys[own]], [count[:, own]]
        if order < ORDER:
            above, counts = out[order + 1]
            k.append(above & np.uint64((1 << (8 * order)) - 1))
            c.append((counts > 0).astype(float))
        k, at = np.unique(np.concatenate(k), return_inverse=True)
        merged = np.zeros((2, len(k)))
        for row in (0, 1):
            np.add.at(merged[row], at, np.concatenate([x[row] for x in c]))
        out[order] = k, merged
    return out


def build(gram: np.ndarray, cls: np.ndarray, n: np.ndarray, toward_one: float = 0.0) -> Model:
    """The model of the counts n of maximal grams by class."""
    counted = levels(gram, cls, n)
    grams, ratios, contexts, passed = [], [], [], []
    lower_keys = lower = None
    for order in range(1, ORDER + 1):
        k, c = counted[order]
        if order <= SHARED_ORDER:
            c = np.stack([c.sum(0)] * 2)
        if order == 1:
            p = (c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * 256)
        else:
            give = discounts(c, toward_one)[:, None]
            context, of = np.unique(k >> np.uint64(8), return_inverse=True)
            total, taken = np.zeros((2, len(context))), np.zeros((2, len(context)))
            for row in (0, 1):
                np.add.at(total[row], of, c[row])
                np.add.at(taken[row], of, np.minimum(c[row], give[row]))
            weight = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
            suffix = k & np.uint64((1 << (8 * (order - 1))) - 1)
            at = np.searchsorted(lower_keys, suffix)  # each gram's suffix is a gram
            p = np.maximum(c - give, 0) / np.maximum(total[:, of], 1) + weight[:, of] * lower[:, at]
            contexts.append(context)
            passed.append(np.log(weight[1] / weight[0]))
        grams.append(k)
        ratios.append(np.log(p[1] / p[0]))
        lower_keys, lower = k, p
    gram_keys, context_keys = np.concatenate(grams), np.concatenate(contexts)
    keys = np.union1d(gram_keys, context_keys)
    ratio, backoff = np.full(len(keys), np.nan), np.zeros(len(keys))
    ratio[np.searchsorted(keys, gram_keys)] = np.concatenate(ratios)
    backoff[np.searchsorted(keys, context_keys)] = np.concatenate(passed)
    table = Table(keys)
    return Model(table, ratio[table.order].astype(np.float32), backoff[table.order].astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope (not negative), intercept and loss by Newton's method with a slight ridge, each row counting as its weight."""
    scale = x.std() or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.array([1e-2, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    margin = np.clip(z @ w, -30, 30) * (2 * y - 1)
    return max(float(w[0] / scale), 0.0), float(w[1]), float((weight * np.log1p(np.exp(-margin))).sum())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", most_rows: int = MOST_ROWS, balanced: bool = True) -> Model | None:
    """A model of at most most_rows labelled documents, or None if either class is missing.

    Rows with a null key or label are not used; a document labelled several times takes the majority, ties toxic; rows that repeat
    a key all count, in the scale once; other columns are not read.  Four fifths of the sample (by hash) give counts, where balanced only as many
    documents of the more common class as the other has, so that neither model is the smoother one; the rest of the sample chooses
    among TOWARD_ONE and gives the scale of scores, each class weighing what it has among all labels.
    """
    small_batches(docs.sparkSession)
    short_reads(docs.sparkSession)
    said = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(toxic) >= 0.5).cast("int").alias("toxic"))
    said = said.withColumn("h", F.xxhash64(F.lit("tox"), "k"))
    sizes = {r["toxic"]: r["count"] for r in said.groupBy("toxic").count().collect()}
    of_class = [said.where(F.col("toxic") == c).orderBy("h", "k").limit(most_rows // 2) for c in (0, 1)]
    picked = of_class[0].unionByName(of_class[1]).toPandas()  # at most most_rows rows of three numbers
    scaled = picked["h"] % 5 == 0
    each = picked[~scaled].groupby("toxic").size()
    if len(each) < 2:
        return None
    picked["part"] = np.where(scaled, "scale", "fit")
    if balanced:
        for c in (0, 1):
            picked.loc[picked[~scaled & (picked["toxic"] == c)].index[each.min() :], "part"] = "spare"
    picked = picked[picked["part"] != "spare"]
    chosen = docs.sparkSession.createDataFrame(picked, said.schema.add("part", "string"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # at most most_rows rows
    fitting, scaling = rows.where("part = 'fit'"), rows.where("part = 'scale'").dropDuplicates(["k"])
    counted = fitting.select("toxic", "text").mapInArrow(_count, "gram long, cls int, n long").groupBy("gram", "cls").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # as many rows as the bounded sample has distinct grams
    gram, cls, n = (got.column(c).to_numpy() for c in ("gram", "cls", "n"))
    if len(set(cls.tolist())) < 2:
        return None
    models = [build(gram, cls, n, t) for t in TOWARD_ONE]
    shipped = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in tc.blocks(batch.column("text")):
                means = np.stack([m.means(data, off) for m in shipped.value], 1)
                yield pa.RecordBatch.from_arrays([pa.array(list(means), pa.list_(pa.float64())), batch.column("toxic")[first:end].cast(pa.float64())], names=["x", "y"])

    held = scaling.select("toxic", "text").mapInArrow(measure, "x array<double>, y double").toArrow()
    shipped.unpersist()
    y = held.column("y").to_numpy()
    if not 0 < y.sum() < len(y):
        return models[-1]
    x = np.array(held.column("x").to_pylist())
    stands_for = [max(1.0, sizes[c] / (most_rows // 2)) for c in (0, 1)]
    weight = np.where(y > 0, stands_for[1], stands_for[0])
    fits = [_logistic(x[:, i], y, weight) for i in range(len(models))]
    best = min(range(len(models)), key=lambda i: (fits[i][2], -i))
    models[best].a, models[best].b, _ = fits[best]
    return models[best]


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 added, in place of a column of that name; very long texts count whole, other columns stay.

    Null and empty texts, having no words, get the score of no evidence; without a model all get 0; an empty table stays empty.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    small_batches(docs.sparkSession)
    short_reads(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [shipped.value.scores(shipped.value.means(data, off)) for _, _, data, off in tc.blocks(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, scored(F.col(text)))
