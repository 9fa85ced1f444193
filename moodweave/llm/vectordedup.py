"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; each of several tables files a vector under the floors of k Gaussian projections of it, shifted and cut
into cells of WIDTH.  Vectors of one bucket are compared by exact cosine in double precision.  k follows the number of vectors, so
that chance brings few together, and the number of tables follows k, so that a pair just at the threshold is missed with the
stated probability only.

Buckets first meet as sketches, the signs of SKETCH more projections: a vector is fetched only for those buckets in which some
other sketch is within FAR bits of its own, which two vectors at the threshold miss less than once in a million times and vectors
at right angles reach as seldom.  So what is shuffled a table is a key and a sketch, however long the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, settle

WIDTH = 1.5
THRESHOLD = 0.95
#: Chance that a pair just at the threshold shares no bucket.
MISS = 0.001
#: Vectors at right angles that a bucket may hold by chance.
STRANGERS = 512
#: Bits of a sketch, and how many of them may differ.
SKETCH, FAR = 128, 32
#: Most vectors of a bucket that are compared as one block; larger buckets are split into pairs of blocks.
BLOCK = 1024


def _meet(distance: float, width: float) -> float:
    """Probability that one projection puts two points at this distance into one cell."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def parameters(n: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS, strangers: int = STRANGERS) -> tuple[int, int]:
    """Projections a table, and tables."""
    near, far = _meet(math.sqrt(max(2 - 2 * threshold, 1e-6)), width), _meet(math.sqrt(2), width)
    k = max(3, math.ceil(math.log(max(n, 2) / strangers) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def _unit(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each index is connected with."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        best = np.where(reach, root[None, :], n).min(1)
        best = best[best]
        if (best == root).all():
            return root
        root = best


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, hold a null or a component that isn't finite, or have a null key link with nothing (such
    a row is its own component; kept is true).  Vectors of different length don't link.  Equal vectors are one class, compared once
    and counted each; repeated rows link with one another.  A pair is counted in the first table whose bucket it shares, so
    nothing has to be made distinct over tables, and no pair leaves a task: tasks give counts and spanning edges.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.elementType.typeName()
    dtype = "<f4" if kind == "float" else "<f8"
    x = F.col(vector)
    fit = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(fit, F.sha2(F.concat_ws(",", F.transform(x, lambda c: c.cast("string"))), 256)).alias("same"), x.alias("x"))
    classes = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("x").alias("x"))
    classes = settle(classes, "vec-classes")
    n = classes.count()
    k, tables = parameters(n, threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("x")
            sizes = np.asarray(lists.value_lengths())
            whole = np.arange(len(sizes))
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    rng = np.random.RandomState(d % (1 << 31) + 17)
                    planes[d] = rng.standard_normal((d, tables * k + SKETCH)), rng.uniform(0, WIDTH, tables * k), rng.randint(1, 1 << 62, k).astype(np.int64) | 1
                a, b, odd = planes[d]
                at = whole[sizes == d]
                values = [np.asarray(lists[i].values.to_numpy(zero_copy_only=False), dtype).tobytes() for i in at.tolist()]
                along = _unit(values, dtype) @ a
                cells = np.floor((along[:, : tables * k] + b) / WIDTH).astype(np.int64).reshape(len(at), tables, k)
                keys = ((cells * odd).sum(2) + np.int64(d)) >> np.int64(24)
                keys = keys.astype(np.int32)
                bits = np.packbits(along[:, tables * k :] > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(at)), batch.column("m").take(pa.array(at)), pa.array(values, pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32())), pa.array([r.tobytes() for r in bits], pa.binary())], names=["rep", "m", "raw", "keys", "buckets", "sketch"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, bucket, lo, hi), g in grouped(batches, by):
            side = g.column("side").to_numpy()
            x = np.unpackbits(np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(len(side), -1), axis=1).astype(np.float32) * 2 - 1
            agree = (x @ x.T) >= SKETCH - 2 * FAR
            agree &= ~np.eye(len(side), dtype=bool) if lo == hi else side[:, None] != side[None, :]
            some = np.flatnonzero(agree.any(1))
            if len(some):
                same = [pa.array(np.full(len(some), v)).cast(g.schema.field(c).type) for c, v in zip(by, (t, bucket, lo, hi), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, g.column("rep").combine_chunks().take(pa.array(some)), pa.array(side[some])], names=[*by, "rep", "side"])

    by = ("t", "bucket", "lo", "hi")
    signed = settle(classes.select("rep", "m", "x").mapInArrow(sign, "rep long, m long, raw binary, keys binary, buckets array<int>, sketch binary"), "vec-signed")
    filed = signed.select("rep", "sketch", F.posexplode("buckets").alias("t", "bucket"))
    sizes = filed.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    block = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = filed.join(sizes, ["t", "bucket"]).select("rep", "sketch", "t", "bucket", block.alias("blocks"))
    mine = F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int")
    spread = placed.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("t", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "sketch", (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = lambda df: df.repartition(*by).sortWithinPartitions(*by)
    near = settle(dealt(spread).mapInArrow(screen, "t int, bucket int, lo int, hi int, rep long, side int"), "vec-near")
    full = dealt(near.join(signed.select("rep", "m", "raw", "keys"), "rep"))

    def compare(t: int, lo: int, hi: int, reps: list, m: np.ndarray, raw: list, keys: np.ndarray, side: np.ndarray):
        degree, edges = np.zeros(len(reps), np.int64), []
        for d in {len(r) for r in raw}:
            at = np.array([i for i, r in enumerate(raw) if len(r) == d])
            if len(at) < 2:
                continue
            u = _unit([raw[i] for i in at], dtype)
            near = u @ u.T >= threshold
            near &= ~np.eye(len(at), dtype=bool)
            if lo != hi:
                near &= side[at][:, None] != side[at][None, :]
            if not near.any():
                continue
            some = np.flatnonzero(near.any(1))
            near, at = near[np.ix_(some, some)], at[some]
            for s in range(t):
                near &= keys[at, s][:, None] != keys[at, s][None, :]
            degree[at] += near @ m[at]
            root = _roots(near)
            edges += [(reps[at[i]], reps[at[r]]) for i, r in enumerate(root.tolist()) if r != i]
        return degree, edges

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            u, v = [*totals, *[e[0] for e in edges]], [*[None] * len(totals), *[e[1] for e in edges]]
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*totals.values(), *[None] * len(edges)], pa.int64())], names=["u", "v", "n"])
            totals.clear(), edges.clear()
            return out

        for (t, _, lo, hi), g in grouped(batches, by):
            reps = g.column("rep").to_pylist()
            keys = np.frombuffer(b"".join(g.column("keys").to_pylist()), np.int32).reshape(len(reps), -1)
            degree, more = compare(t, lo, hi, reps, g.column("m").to_numpy(), g.column("raw").to_pylist(), keys, g.column("side").to_numpy())
            for i in np.flatnonzero(degree).tolist():
                totals[reps[i]] = totals.get(reps[i], 0) + int(degree[i])
            edges.extend(more)
            if len(totals) + len(edges) > 50_000:
                yield flush()
        yield flush()

    found = settle(full.mapInArrow(scan, "u long, v long, n long"), "vec-links")
    discard(near)
    links = found.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("v is not null").select("u", "v"), "vec-cc")
    known = classes.select("same", "rep", "m").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("same", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "same").join(known, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows that agree on the columns `by`, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        changes = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[first].item() for c in columns)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                current, held = key, []
            held.append(batch.slice(first, end - first))
    if held:
        yield current, pa.Table.from_batches(held)
