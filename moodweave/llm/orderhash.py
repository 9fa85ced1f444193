"""Document fingerprints by Order MinHash.

A document's words (maximal runs of characters other than ASCII white space) give k-mers of K words; the i-th occurrence of a
k-mer is an element of its own.  Each of SKETCHES seeded orders picks the L smallest elements, lists their k-mers in text order
and hashes that tuple.  Two texts agree on a sketch when they hold the same k-mers in the same order, so the share of equal
sketches falls with edit distance and with rearrangement.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .store import small_batches

K = 5
L = 2
SKETCHES = 64
#: Keys sampled for each range of keys, which also is the least number of sampled keys that a range is made for.
SAMPLED = 32
_rng = np.random.RandomState(20240501)
_XOR, _MULTIPLY, _TAG = ((_rng.randint(0, 1 << 32, SKETCHES).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, SKETCHES).astype(np.uint64) | np.uint64(1) for _ in range(3))
#: Most elements times sketches that are held at once.
_CELLS = 1 << 21


def numbered(kmers: np.ndarray) -> np.ndarray:
    """Element hashes: each k-mer with the number of its occurrence so far."""
    ordered = np.sort(kmers)
    if not (ordered[1:] == ordered[:-1]).any():
        return tc.mix(kmers)
    by = np.argsort(kmers, kind="stable")
    same = np.concatenate([[False], kmers[by][1:] == kmers[by][:-1]])
    place = np.arange(len(kmers))
    number = np.empty(len(kmers), np.uint64)
    number[by] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
    return tc.mix(kmers + number * np.uint64(0xA0761D6478BD642F))


def sketches(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES 16-bit hashes of one document's k-mers; zeros for a document without words."""
    n = len(kmers)
    out = np.zeros(SKETCHES, np.uint16)
    if not n:
        return out
    elements = numbered(kmers)
    step = max(1, _CELLS // n)
    for first in range(0, SKETCHES, step):
        own = slice(first, min(first + step, SKETCHES))
        order = (elements[None, :] ^ _XOR[own, None]) * _MULTIPLY[own, None]
        order ^= order >> np.uint64(29)
        row, picked = np.arange(order.shape[0]), []
        for _ in range(min(L, n)):
            at = order.argmin(1)
            picked.append(at)
            order[row, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        acc = _TAG[own].copy()
        for at in np.sort(np.stack(picked), axis=0):  # text order
            acc = tc.mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ kmers[at])
        out[own] = (acc >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """[documents, SKETCHES] sketches of whole texts."""
    out = np.zeros((len(texts), SKETCHES), np.uint16)
    for first, _, data, off in tc.blocks(texts):
        starts, ends, woff = tc.words(data, off, tc.NOT_SPACE)
        kmers, koff = tc.shingles(tc.span_hashes(data, starts, ends), woff, K)
        for d in range(len(koff) - 1):
            out[first + d] = sketches(kmers[koff[d] : koff[d + 1]])
    return out


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _bounds(docs: DataFrame, key: str, parts: int) -> list[tuple]:
    """Ascending bounds (key, text hash) of about `parts` even ranges, from at most SAMPLED keys a part, those of the lowest hashes.

    A key that would fill several ranges is divided among them by the hashes of its texts, which spread evenly.
    """
    keys = docs.select(F.col(key).alias("key")).where("key is not null")
    got = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key")).limit(SAMPLED * parts).collect())
    n = min(parts, len(got) // SAMPLED)
    cuts = [got[i * len(got) // n] for i in range(1, n)]
    return [(k, -(1 << 63) + j * (1 << 64) // times) for k, times in Counter(cuts).items() for j in range(times)]


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (part, extra, key, tie, text) such that within a part, sorted by extra, key descending (nulls last) and tie descending, each
    row that isn't extra is followed by the next document in descending key order, after the last by the first.

    Parts are ranges of the key and of tie, the text's hash; each also gets, as an extra row, a copy of the first document of the
    part after it.  Only a sample of keys and the first key of each part come to the driver; both grow with the parts, not with
    the rows.  A row finds its part by bisection, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs, key, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shipped = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def part_of(keys: pa.Array, ties: pa.Array) -> pa.Array:
        b = shipped.value
        return pa.array([len(b) + 1 if k is None else len(b) - bisect_right(b, (k, t)) for k, t in zip(keys.to_pylist(), ties.to_pylist(), strict=True)], pa.int32())

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.withColumn("part", part_of("key", "tie"))
    first = placed.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).select("part", "head.key", "head.tie").collect()
    heads = sorted(first, key=lambda r: r["part"])
    wanted = spark.createDataFrame([(heads[at - 1]["part"], r["key"], r["tie"]) for at, r in enumerate(heads)], T.StructType([T.StructField("goes_to", T.IntegerType()), T.StructField("k", docs.schema[key].dataType), T.StructField("t", T.LongType())]))
    found = placed.join(F.broadcast(wanted), F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")), "left")  # a row a part
    places = F.filter(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("goes_to").alias("part"), F.lit(True).alias("extra"))), lambda p: p["part"].isNotNull())
    spread = found.select(F.explode(places).alias("p"), "key", "tie", "text").select("p.part", "p.extra", "key", "tie", "text")
    return spread.repartitionById(len(bounds) + 2, "part").sortWithinPartitions("part", "extra", F.col("key").desc_nulls_last(), F.desc("tie"), "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    descending key order.  A null text is empty; a document without words has a fingerprint of zeros, so all such are alike;
    one of fewer than K words has one k-mer, all its words.  Keys may be of any type that sorts.  Rows that share a key follow
    each other by the hash of their text, null keys come last, a single row is its own next document, and an empty table gives
    an empty result.  Very long texts are taken whole, one at a time.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(key).alias("doc_id")).schema.add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: part, extra, key, text, sketches
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = fingerprints(batch.column("text"))
            rows = list(zip(batch.column("part").to_pylist(), batch.column("extra").to_pylist(), batch.column("key").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), prints, strict=True))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            edited = []
            for a, b in pairs:
                half = len(a[3]) // 2
                edited.append(a[3][: len(a[3]) - half] + b[3][:half])
            after = fingerprints(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], batch.column("key").type),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([_hex(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([_hex(x) for x in after], pa.string()),
                    pa.array([float((a[4] == x).mean()) for (a, _), x in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([float((a[4] == b[4]).mean()) for a, b in pairs], pa.float64()),
                ],
                names=schema.names,
            )

    return with_next(docs, key, text).mapInArrow(read, schema)
