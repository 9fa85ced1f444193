"""Near-duplicate documents by consistent weighted sampling.

A document's shingles (runs of five words, case folded) weigh their number times a smoothed inverse document frequency.  Improved
consistent weighted sampling draws SAMPLES shingles a document, such that two documents draw the same one with a probability equal
to their weighted Jaccard similarity; bands of samples file documents into buckets, and documents of one bucket are verified by
that similarity itself, over whole texts.

Document frequencies are over all documents, for every shingle that at least RARE of the documents hold; rarer ones weigh as if
that many did.  At most (shingles a document) / RARE shingles can be that frequent, so their table stays small and is sent to
executors whatever the size of the corpus.  A large group of near copies would make its own shingles frequent and hence light,
until what its members do not share outweighed all that they do; so documents that are frequent shingles for the most part count
once for all that agree in their least one, and a passage that many different documents hold counts with each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import connected_components
from .store import discard, is_small, settle, small_batches, unused
from .vectordedup import _roots, grouped

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
RARE = 0.01
#: Share of frequent shingles from which on documents are taken for copies of one another where frequencies are counted.
MOSTLY = 0.5
#: Most documents, and bytes of text, of a bucket that are compared at once (two documents always are).
BLOCK, BLOCK_BYTES = 192, 64 << 20
#: The bitmap of what may go has two to the power of this many bits at most.
MOST_BITS = 29

_rng = np.random.RandomState(20240907)
_SEEDS = (_rng.randint(0, 1 << 32, SAMPLES).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, SAMPLES).astype(np.uint64) | np.uint64(1)


def _gamma_quantiles(n: int) -> np.ndarray:
    """The gamma distribution of shape 2 at n evenly spread probabilities, by bisection of 1 - (1 + x) exp(-x)."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


_R = _gamma_quantiles(1 << 12).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


@dataclass
class Weights:
    """Inverse document frequencies: of the frequent shingles, by sorted hash, and of all others."""

    hashes: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.idf[at[known]]
        return out


def _bags(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in ascending order, their numbers, and the documents' offsets into them."""
    starts, ends, woff = tc.words(data, off, tc.ALNUM)
    h, soff = tc.shingles(tc.span_hashes(tc.LOWER[data], starts, ends), woff, WORDS)
    for a, b in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True):
        h[a:b].sort()
    if not len(h):
        return h, np.zeros(0, np.int64), soff
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[soff[:-1][soff[:-1] < len(h)]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, soff)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1, where fewer than RARE of the n documents count as that many."""
    return np.log((1 + n) / (1 + np.maximum(df, RARE * n))) + 1


def document_frequencies(docs: DataFrame, text: str = "text") -> Weights:
    """Two passes: which shingles may be frequent, and how many documents, copies counting once, hold those.

    A shingle that RARE of all documents hold is held by at least half that share in blocks where half that share holds it; so
    blocks report what passes RARE / 2 locally, and sums that pass RARE / 2 of all documents are the candidates, at most
    2 / RARE times the shingles of a mean document.
    """
    spark = docs.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = size = 0

        def report() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            keep = c >= max(1, math.ceil(n * RARE / 2))
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[keep].view(np.int64), 0)), pa.array(np.append(c[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), n))], names=["h", "c", "n"])

        for batch in batches:
            for first, end, data, off in tc.blocks(batch.column("text")):
                h, _, _ = _bags(data, off)
                held.append(h)
                n, size = n + end - first, size + len(h)
                if size >= 3 << 20:
                    yield report()
                    held, n, size = [], 0, 0
        if n:
            yield report()

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"))
    sums = settle(texts.mapInArrow(local, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "df-local")
    n = sums.agg(F.sum("n")).first()[0] or 0
    got = sums.where(F.col("c") >= max(2, n * RARE / 2)).select("h").toArrow().column("h").to_numpy()
    discard(sums)
    if not len(got):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), float(idf_of(np.zeros(1), n)[0]))
    maybe = spark.sparkContext.broadcast(np.sort(got.view(np.uint64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = maybe.value
        order_of = np.sort(tc.mix(wanted))  # a group is named by its least shingle's rank
        total, single = np.zeros(len(wanted), np.int64), 0
        seen: set[int] = set()  # pairs of a group of copies and a shingle's place
        for batch in batches:
            for _, _, data, off in tc.blocks(batch.column("text")):
                h, _, hoff = _bags(data, off)
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                hit = wanted[at] == h
                each = np.concatenate([[0], np.cumsum(hit)])
                held = each[hoff[1:]] - each[hoff[:-1]]
                copies = (held > 0) & (held >= MOSTLY * np.diff(hoff))
                doc = np.repeat(np.arange(len(copies)), np.diff(hoff))[hit]
                at = at[hit]
                total += np.bincount(at[~copies[doc]], minlength=len(wanted))
                single += int((~copies).sum())
                if copies.any():
                    least = np.minimum.reduceat(tc.mix(wanted[at]), np.minimum(each[hoff[:-1]], max(0, len(at) - 1)))
                    least = np.searchsorted(order_of, least)
                    mine = copies[doc]
                    seen.update(np.unique(least[doc[mine]] * len(wanted) + at[mine]).tolist())
        some = np.flatnonzero(total)
        pairs = np.array(sorted(seen), np.int64)
        group, at = pairs // len(wanted), pairs % len(wanted)
        place = np.searchsorted(order_of, tc.mix(wanted[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, at)), pa.array(np.append(np.full(len(some), -1), group)), pa.array(np.append(total[some], np.zeros(len(at), np.int64))), pa.array(np.append(np.zeros(len(some), np.int64), group == place))], names=["at", "g", "c", "names"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([single]), pa.array([0])], names=["at", "g", "c", "names"])

    # A group holds the shingle that it is named by, so such shingles number the groups.
    held = texts.mapInArrow(count, "at long, g long, c long, names long").groupBy("at", "g").agg(F.sum("c").alias("c"), F.max("names").alias("names"))
    exact = held.groupBy("at").agg((F.sum("c") + F.count_if(F.col("g") >= 0)).alias("c"), F.max("names").alias("names")).toArrow()
    at, c = exact.column("at").to_numpy(), exact.column("c").to_numpy()
    n = int(c[at < 0].sum()) + int(exact.column("names").to_numpy().sum())
    h, c = maybe.value[at[at >= 0]], c[at >= 0]
    order = np.argsort(h)
    return Weights(h[order], idf_of(c[order], n), float(idf_of(np.zeros(1), n)[0]))


def draw(hashes: np.ndarray, weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[documents with shingles, SAMPLES] consistent weighted samples of documents laid end to end.

    Per shingle and sample: r and c of the gamma distribution and b uniform, all by hash; t = floor(ln w / r + b); the shingle
    with the least ln c - r (t - b + 1) is drawn, together with its t.
    """
    log_w = np.log(weights).astype(np.float32)
    out = np.empty((len(off) - 1, SAMPLES), np.uint64)
    for s in range(SAMPLES):
        v = (hashes ^ _SEEDS[s]) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(30)
        r = _R[(v & np.uint64(0xFFF)).astype(np.int32)]
        b = ((v >> np.uint64(12)) & np.uint64(0xFFF)).astype(np.float32)
        b *= np.float32(1 / 4096)
        t = log_w / r
        t += b
        np.floor(t, out=t)
        y = t - b
        y += np.float32(1)
        y *= r
        a = _LOG_C[((v >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int32)]
        a -= y
        a += np.float32(96)  # positive, so that its bits order as it does
        key = a.view(np.uint32).astype(np.uint64) << np.uint64(32)
        key |= (v >> np.uint64(32)) ^ (t.astype(np.int64).view(np.uint64) & np.uint64(0xFFFF))
        out[:, s] = np.minimum.reduceat(key, off[:-1])
    return out & np.uint64(0xFFFFFFFF)


def bands(drawn: np.ndarray) -> np.ndarray:
    """[documents, BANDS] bucket keys."""
    out = np.zeros((len(drawn), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(drawn), b + 1, np.uint64)
        for r in range(ROWS):
            acc = tc.mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ drawn[:, b * ROWS + r])
        out[:, b] = acc
    return out.view(np.int64)


def similarities(data: np.ndarray, off: np.ndarray, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a few documents; 0 with documents without shingles.

    The n-th occurrence of a shingle counts as an element with the shingle's weight, which makes minima of counts plain
    intersections: a matrix product over the elements that two documents share.
    """
    h, n, hoff = _bags(data, off)
    docs = len(off) - 1
    doc = np.repeat(np.arange(docs), np.diff(hoff))
    w = weights.of(h)
    total = np.bincount(doc, w * n, docs)
    if n.max(initial=1) > 1:
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, w, h = np.repeat(doc, n), np.repeat(w, n), np.repeat(h, n)
        h = np.where(number > 0, tc.mix(h + number.astype(np.uint64)), h)
    element, which, held = np.unique(h, return_inverse=True, return_counts=True)
    shared = held[which] > 1
    column = np.cumsum(held > 1) - 1
    inter = np.zeros((docs, docs))
    at, doc, w = column[which[shared]], doc[shared], np.sqrt(w[shared])
    order = np.argsort(at, kind="stable")
    at, doc, w = at[order], doc[order], w[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (first, first + 4096))
        x = np.zeros((docs, 4096), np.float32)
        x[doc[a:b], at[a:b] - first] = w[a:b]
        inter += x @ x.T
    union = total[:, None] + total[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _verify(members: DataFrame, classes: DataFrame, texts: DataFrame, weights: Weights, label: str) -> DataFrame:
    """Edges (u, v) that connect similar texts within each group of members(a, b, c, id, side): all pairs where the group has side 0
    only, else pairs of differing sides or of two zeros.  A text is fetched once a group it is in, from the document that stands
    for its class.  Where few are asked for, their keys are broadcast first, so that only their texts are shuffled."""
    shipped = members.sparkSession.sparkContext.broadcast(weights)
    reps = classes.select("id", "rep", "same").join(members.select("id").distinct(), "id", "left_semi")
    if is_small(reps, 96):
        reps = F.broadcast(reps)
    named = texts.join(reps, ["rep", "same"]).select("id", "text")
    full = named.hint("shuffle_hash").join(members.hint("shuffle_hash"), "id").repartition("a", "b", "c").sortWithinPartitions("a", "b", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in grouped(batches, ("a", "b", "c")):
            ids, side = g.column("id").to_numpy(), g.column("side").to_numpy()
            _, keep = np.unique(ids, return_index=True)
            if len(keep) < 2:
                continue
            data, off = tc.utf8(g.column("text").take(pa.array(keep)))
            ids, side = ids[keep], side[keep]
            near = similarities(data, off, shipped.value) >= THRESHOLD - 1e-6
            near &= ~((side[:, None] == 1) & (side[None, :] == 1))
            root = _roots(near)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["u", "v"])

    return settle(full.select("a", "b", "c", "id", "side", "text").mapInArrow(compare, "u long, v long"), label)


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same) of every row, same being the text's MD5, and (same, component_id, first) of every text of rows with a key:
    the class's least doc_id and its text's MD5."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = document_frequencies(rows)
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in tc.blocks(batch.column("text"), 1 << 18):
                h, n, hoff = _bags(data, off)
                some = np.flatnonzero(np.diff(hoff))
                keys: list = [None] * (end - first)
                if len(some):
                    own = bands(draw(h, weights_of(h, n), np.append(hoff[some], hoff[-1])))
                    for d, k in zip(some.tolist(), own, strict=True):
                        keys[d] = k
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], batch.column("same")[first:end], pa.array(np.diff(off)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "bytes", "bands"])

    def weights_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return shipped.value.of(h) * n

    named = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("same"), "text")
    signed = settle(named.mapInArrow(sign, "doc_id long, same string, bytes long, bands array<long>"), "near-signed")
    grouped_by_text = signed.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    classes = settle(grouped_by_text.withColumn("id", F.monotonically_increasing_id()), "near-classes")  # written once, so ids hold
    filed = classes.select("id", "bytes", F.posexplode("bands").alias("band", "bucket")).withColumn("bucket", F.xxhash64("band", "bucket"))
    cut = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 24))).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.min("id").alias("hub")).where("size > 1")
    # Buckets of the same members, as most of a pair's are, are compared once.
    buckets = settle(sizes.groupBy("size", "bytes", "s", "x", "hub").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "hub", F.least(cut(F.col("size"), F.col("bytes")), F.col("size").cast("int")).alias("blocks")), "near-buckets")
    members = settle(filed.join(buckets.select("bucket", "blocks"), "bucket").select("bucket", "id", "bytes", "blocks", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int").alias("block")), "near-members")
    one = F.lit(0).alias("b")
    first = members.select(F.col("bucket").alias("a"), one, F.col("block").alias("c"), "id", F.lit(0).alias("side"))
    hubs = buckets.where("blocks > 1").select(F.col("bucket").alias("a"), one, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"), F.col("hub").alias("id"), F.lit(0).alias("side"))
    texts = named.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "same", "text")
    edges = _verify(first.unionByName(hubs), classes, texts, weights, "near-edges")
    linked, made = edges, []
    large = members.where("blocks > 1")
    if not large.isEmpty():
        parts = connected_components(edges, "near-cc1")
        known = large.join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).select("bucket", "id", "bytes", "part", "block")
        known = settle(known, "near-known")
        counted = known.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
        main = counted.groupBy("bucket").agg(F.max(F.struct("n", "part", "size")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("bytes_all")).where("m.n < all")
        main = main.select("bucket", F.col("m.part").alias("main"), cut(F.col("all") - F.col("m.n"), F.col("bytes_all") - F.col("m.size")).alias("outs"), cut(F.col("m.n"), F.col("m.size")).alias("ins"))
        open_ = settle(known.join(main, "bucket"), "near-open")
        h = F.xxhash64("id", F.lit(7))
        outer = open_.where("part <> main").withColumn("own", F.pmod(h, F.col("outs")).cast("int"))
        inner = open_.where("part = main").withColumn("own", F.pmod(h, F.col("ins")).cast("int"))
        cell = lambda i, j: F.shiftleft(i.cast("long"), 32) + j.cast("long")
        groups = [
            outer.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("ins") - 1))).select("bucket", cell(F.col("own"), F.col("o")).alias("c"), "id", F.lit(0).alias("side")),
            inner.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).select("bucket", cell(F.col("o"), F.col("own")).alias("c"), "id", F.lit(1).alias("side")),
            outer.where("outs > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).select("bucket", (-1 - cell(F.least("own", "o"), F.greatest("own", "o"))).alias("c"), "id", F.lit(0).alias("side")),
        ]
        again = groups[0].unionByName(groups[1]).unionByName(groups[2]).select(F.col("bucket").alias("a"), one, "c", "id", "side")
        made += [parts, known, open_, more := _verify(again, classes, texts, weights, "near-edges2")]
        linked = edges.unionByName(more)
    made.append(whole := connected_components(linked, "near-cc"))
    parts = whole.join(classes.select("id", "same", "rep"), F.col("node") == F.col("id"))
    firsts = parts.groupBy("component").agg(F.min(F.struct("rep", "same")).alias("f"))
    found = settle(parts.join(firsts, "component").select("same", "f"), "near-firsts")
    for done in (*made, buckets, members, edges):
        discard(done)
    known = classes.select("same", "rep").join(found, "same", "left").select("same", F.coalesce("f.rep", "rep").alias("component_id"), F.coalesce("f.same", "same").alias("first"))
    return signed.select("doc_id", "same"), known


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id (least doc_id of its class) and kept (it is that document).

    A class is what a chain of exact copies or of pairs of similarity THRESHOLD or more connects.  Null texts are empty; texts
    without words are similar only to exact copies; one of fewer than five words has one shingle.  A row with a null key is a class
    of its own (component null, kept true).  Rows that share a key but not their text are documents of their own; rows that share
    both are alike.  Very long texts are taken whole; an empty table gives an empty result.  Other columns are not read.

    Exact copies enter the comparison once.  A bucket of more than BLOCK documents, or of more than BLOCK_BYTES of text, is first
    compared in blocks that all hold the bucket's first document; then, across blocks, only documents that are not yet connected
    are compared, so a large group of near copies costs about as much as it has members and no pair of different texts in a
    bucket is left out.
    """
    signed, known = _classes(docs, key, text)
    out = signed.withColumn("same", F.when(F.col("doc_id").isNotNull(), F.col("same"))).join(known, "same", "left")
    return out.select("doc_id", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("same").eqNullSafe(F.col("first"))).alias("kept"))


def _marks(rows: DataFrame, h: Column) -> np.ndarray:
    """Words of a bitmap in which each row's hash sets a bit: 64 bits a row at least, up to MOST_BITS of them in all."""
    bits = 1 << min(MOST_BITS, max(16, (64 * rows.count()).bit_length()))
    at = F.pmod(h, F.lit(bits))
    got = rows.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("w")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[got.column("i").to_numpy()] = got.column("w").to_numpy()
    return words


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each class, and of rows that share key and text without all but any one; rows with a
    null key stay.  Long texts, nulls and empty tables are as in `find_groups`; columns stay, whatever their names.

    A bitmap of bounded size tells which documents may go; all others pass without a shuffle, and those few are held against
    what goes.
    """
    signed, known = _classes(docs, key, text)
    rows = signed.where("doc_id is not null").groupBy("doc_id", "same").agg(F.count("*").alias("times"))
    rows = rows.join(known, "same").withColumn("kept", (F.col("doc_id") == F.col("component_id")) & (F.col("same") == F.col("first")))
    k, m = unused(docs, "of_key", "of_text")
    odd = settle(rows.where("not kept or times > 1").select(F.col("doc_id").alias(k), F.col("same").alias(m), "kept"), "near-gone")
    same = F.md5(F.coalesce(F.col(text), F.lit("")))
    shipped = docs.sparkSession.sparkContext.broadcast(_marks(odd, F.xxhash64(k, m)))

    @F.arrow_udf("boolean")
    def marked(hashes: pa.Array) -> pa.Array:
        words = shipped.value
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(64 * len(words) - 1)
        return pa.array((words[(h >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (h & np.uint64(63)) & np.uint64(1)).astype(bool))

    may_go = F.col(key).isNotNull() & marked(F.xxhash64(F.col(key).cast("long"), same))
    asked = docs.where(may_go)
    met = (asked[key] == F.col(k)) & (F.md5(F.coalesce(asked[text], F.lit(""))) == F.col(m))
    out = docs.where(~may_go).unionByName(asked.join(odd.select(k, m), met, "left_anti"))
    again = odd.where("kept")
    if not again.isEmpty():
        out = out.unionByName(asked.join(again.select(k, m), met, "left_semi").dropDuplicates([key, text]))
    return out
