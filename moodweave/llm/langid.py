"""Language identification by string kernels.

The blended-spectrum presence kernel counts the n-grams (n = 1 to 4, over UTF-8 bytes) that two texts both have, divided by the
geometric mean of how many each has.  A text is taken in windows of WINDOW bytes and its kernel values are the means over them,
by their lengths, so that a long text, which has nearly every n-gram somewhere, is told apart as well as a short one.  Nystrom
landmarks (windows of learnt documents) turn the kernel into features, one-versus-rest kernel ridge regression gives a weight
vector a language, and windows are scored by batched matrix products of their presence by the landmarks' weighted n-grams.

N-grams are exact, not hashed.  Training takes at most `most_rows` labelled documents (those with the lowest seeded hashes), all
landmarks among them, so neither the model nor what the driver gathers grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import discard, settle, small_batches, unused

ORDERS = (1, 2, 3, 4)
WINDOW = 4096
MOST_ROWS = 3000
LANDMARKS = 192
RIDGE = 1e-2
_SEGMENT = 1 << 19
#: Most cells of a matrix of presence.
_CELLS = 1 << 21
_KEY_BITS = 35
#: ASCII case is folded and digits are alike.
_FOLDED = tc.LOWER.astype(np.int64)
_FOLDED[48:58] = 48


@dataclass
class Windows:
    """A run of windows: the document (row) and length in bytes of each, its distinct n-grams in ascending order and their offsets."""

    doc: np.ndarray
    size: np.ndarray
    grams: np.ndarray
    off: np.ndarray


def windows(column: pa.Array) -> Iterator[Windows]:
    """The windows of whole texts, for about _SEGMENT bytes at a time, so memory doesn't grow with a text's length.

    A window has the n-grams that begin in it, also where they end in the next; none spans two documents.
    """
    for first, end, data, off in tc.blocks(column, _SEGMENT):
        count = -(-np.diff(off) // WINDOW)
        doc = np.repeat(np.arange(end - first), count)
        start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        last = off[doc + 1]
        stop = np.minimum(start + WINDOW, last)
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(stop, start[i] + _SEGMENT, "right")))
            low = _FOLDED[data[start[i] : min(stop[j - 1] + max(ORDERS) - 1, last[j - 1])]]
            size = stop[i:j] - start[i:j]
            window = np.repeat(np.arange(j - i, dtype=np.int64), size)
            left = np.repeat(last[i:j] - start[i], size) - np.arange(len(window))  # bytes from each place to its document's end
            keys, acc = [], np.zeros(len(low), np.int64)
            for n in ORDERS:
                if len(low) < n:
                    break
                acc = (acc[: len(low) - n + 1] << 8) | low[n - 1 :]
                m = min(len(acc), len(window))
                whole = left[:m] >= n
                keys.append(((window[:m] << _KEY_BITS) | (n << 32) | acc[:m])[whole])
            found = np.sort(np.concatenate(keys))
            found = found[np.append(True, found[1:] != found[:-1])]
            of = found >> _KEY_BITS
            yield Windows(first + doc[i:j], size, found & ((1 << _KEY_BITS) - 1), np.searchsorted(of, np.arange(j - i + 1)))
            i = j


def _sums(runs: Iterator[Windows], vocabulary: np.ndarray, table: np.ndarray, docs: int) -> np.ndarray:
    """[docs, columns of table]: over each document's windows, the mean by length of presence times table by the root of the window's number of n-grams."""
    out, total = np.zeros((docs, table.shape[1])), np.zeros(docs)
    step = max(1, _CELLS // max(1, len(vocabulary)))
    for w in runs:
        at = np.minimum(np.searchsorted(vocabulary, w.grams), len(vocabulary) - 1)
        known = vocabulary[at] == w.grams
        held = np.diff(w.off)
        of = np.repeat(np.arange(len(held)), held)[known]
        at = at[known]
        for a in range(0, len(held), step):
            b = min(a + step, len(held))
            lo, hi = np.searchsorted(of, (a, b))
            x = np.zeros((b - a, len(vocabulary)), np.float32)
            x[of[lo:hi] - a, at[lo:hi]] = 1
            np.add.at(out, w.doc[a:b], (x @ table) * (w.size[a:b] / np.sqrt(held[a:b]))[:, None])
        np.add.at(total, w.doc, w.size)
    return out / np.maximum(total, 1)[:, None]


@dataclass
class Landmarks:
    """Distinct n-grams of all landmarks, and which landmark holds each, divided by the root of the landmark's number of them."""

    vocabulary: np.ndarray
    table: np.ndarray  # [n-grams, landmarks] float32

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        vocabulary = np.unique(np.concatenate(sets))
        table = np.zeros((len(vocabulary), len(sets)), np.float32)
        for i, s in enumerate(sets):
            table[np.searchsorted(vocabulary, s), i] = 1 / np.sqrt(len(s))
        return cls(vocabulary, table)

    def kernel(self, column: pa.Array) -> np.ndarray:
        """[documents, landmarks] kernel values of whole texts; 0 for empty ones."""
        return _sums(windows(column), self.vocabulary, self.table, len(column))


def ridge(k: np.ndarray, inner: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights [landmarks, classes] and biases of one-versus-rest ridge regression on Nystrom features of the kernel values k.

    inner are the landmarks' kernel values among themselves.  Targets are +1 and -1; each class weighs as much as any other.
    """
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([k @ to_features, np.ones((len(k), 1))])
    weight = (1 / np.bincount(y, minlength=classes))[y]
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) * classes / 10
    coef = np.linalg.solve(gram, (phi * weight[:, None]).T @ (2.0 * (y[:, None] == np.arange(classes)) - 1))
    return to_features @ coef[:-1], coef[-1]


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray
    table: np.ndarray  # [n-grams, languages] float32: the landmarks' n-grams by the weights
    bias: np.ndarray  # [languages]

    def margins(self, column: pa.Array) -> np.ndarray:
        """[documents, languages] decision values of whole texts."""
        return _sums(windows(column), self.vocabulary, self.table, len(column)) + self.bias


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = MOST_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most most_rows documents with a language and a letter; None if there is none.

    Rows with a null key are not used; of rows repeating a key any may be.  Classes are weighted so that a rare language counts as
    much as a common one.  A landmark is the first window of a document.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("k is not null and lang is not null")
    picked = rows.select("k", F.xxhash64(F.lit("lang"), "k").alias("h")).orderBy("h", "k").limit(most_rows).distinct()
    sample = settle(rows.join(F.broadcast(picked), "k").where(F.col("text").rlike(r"\p{L}")).dropDuplicates(["k"]), "lang-sample")  # at most most_rows keys
    known = sample.select("h", "lang").orderBy("h", "lang").limit(most_rows).toPandas()
    if not len(known):
        return None
    langs, y = np.unique(known["lang"].to_numpy(str), return_inverse=True)
    per = max(1, landmarks // len(langs))
    marked = {(int(known["h"][i]), langs[c]) for c in range(len(langs)) for i in np.flatnonzero(y == c)[:per]}

    def first_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = pa.array([x in marked for x in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), strict=True)])
            batch = batch.filter(mine)
            starts = pa.array([t[:WINDOW] for t in batch.column("text").to_pylist()], pa.string())  # a character is a byte or more
            seen: dict[int, np.ndarray] = {}
            for w in windows(starts):
                for i, d in enumerate(w.doc.tolist()):
                    seen.setdefault(d, w.grams[w.off[i] : w.off[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([seen[d] for d in range(batch.num_rows)], pa.list_(pa.int64()))], names=["h", "grams"])

    sets = sample.select("h", "lang", "text").mapInArrow(first_window, "h long, grams array<long>").toArrow()  # as many rows as landmarks
    order = np.argsort(sets.column("h").to_numpy(), kind="stable")
    grams = sets.column("grams").to_pylist()
    marks = Landmarks.of([np.array(grams[i], np.int64) for i in order])
    shipped = docs.sparkSession.sparkContext.broadcast(marks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shipped.value.kernel(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(values), pa.list_(pa.float64()))], names=["lang", "k"])

    got = sample.select("lang", "text").mapInArrow(measure, "lang string, k array<double>").toArrow()  # at most most_rows rows of kernel values
    shipped.unpersist()
    discard(sample)
    k, y = np.array(got.column("k").to_pylist()), np.searchsorted(langs, np.array(got.column("lang").to_pylist(), str))
    order = np.lexsort((*k.T[::-1], y))  # sums do not depend on the order in which rows came
    weights, bias = ridge(k[order], (marks.table.T @ marks.table).astype(np.float64), y[order], len(langs))
    return Model([str(x) for x in langs], marks.vocabulary, (marks.table @ weights).astype(np.float32), bias)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) added, in place of columns of these names; `und` and 0 where the text is null or has no
    letter, or nothing was learned.  Long texts count whole, by windows.  Rows that repeat, other columns and empty tables stay."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<best:int,score:double>")
    def decided(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            f = shipped.value.margins(column)
            yield pa.StructArray.from_arrays([pa.array(f.argmax(1).astype(np.int32)), pa.array(np.clip((f.max(1) + 1) / 2, 0, 1))], names=["best", "score"])

    names = F.array(*map(F.lit, model.langs))
    (said,) = unused(docs, "said")
    out = docs.withColumn(said, decided(F.col(text)))
    pred, score = F.when(letters, F.element_at(names, F.col(said)["best"] + 1)).otherwise("und"), F.when(letters, F.col(said)["score"]).otherwise(0.0)
    return out.withColumns({"lang_pred": pred, "score": score}).drop(said)
