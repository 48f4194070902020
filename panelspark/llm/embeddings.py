"""Embedding near-duplicates by cross-polytope hashing, with multiprobe buckets and verified pairs.

A vector is normalised, padded to a power of two d and rotated by three rounds of random signs and a fast Hadamard
transform.  Its hash is the nearest vertex of the cross-polytope, the coordinate of greatest size with its sign (2 d
vertices).  A table joins ``depth`` such hashes; a vector goes to its own bucket and to the ``PROBES`` - 1 next best ones,
where one hash takes its second vertex at the least loss.  ``depth`` follows from the number of vectors, so that few meet
by chance, and the number of tables from the chance that a table's whole key, probes included, of two vectors at the
threshold agrees, so that they meet with probability ``CHANCE`` or more.  That chance falls with the dimension, and faster
than a power of one hash's with ``depth``, as all hashes share the probes: it is measured on made pairs.

Equal vectors are one class and are compared once.  Only bucket numbers are shuffled at first; a vector is sent to those
of its buckets that hold another one.  Inside a bucket all pairs are verified by their cosine in double
precision.  A pair that meets in several buckets counts in the first alone, which both vectors' bucket lists give.  A
bucket yields one row for each linked member: how many vectors it links there, and the root of its local component; no
pairs leave the task.  A bucket of more than ``BLOCK`` classes is cut into blocks whose pairs are tasks of their own
(exact, nothing is capped).  Components come from label propagation over the local roots.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different length never link; rows with equal vec_id are vectors of their own, each counted;
null ids link but give a component no id; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import materialise, partitions, smallest_reachable

THRESHOLD = 0.9
PROBES = 4
CHANCE = 0.995
#: The most that counts for each hash of a key, whatever is measured; the pairs and tables of that measurement.
MEET = 0.72
PAIRS, TRIALS = 400, 4
BLOCK = 2048
ROOM = 2
SEED = 2


@cache
def meeting(dims: int, depth: int, threshold: float = THRESHOLD) -> float:
    """The chance that two vectors at the threshold share a bucket of one table: two standard errors below the share of
    made pairs that do."""
    pick, dims = np.random.default_rng((SEED, dims, depth)), max(2, dims)
    x, z = pick.normal(size=(2, PAIRS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (bucket_keys(v, TRIALS, depth) for v in (x, y))
    share = float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())
    n = PAIRS * TRIALS
    return max(1 / n, share - 2 * math.sqrt(share * (1 - share) / n))


def shape(n: int, dims: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, depth) for n vectors: ``ROOM`` buckets or more for each, so that few meet by chance."""
    vertices = 2 * (1 << max(1, (dims - 1).bit_length()))
    depth = max(1, math.ceil(math.log(max(n * ROOM, 2)) / math.log(vertices)))
    met = min(MEET ** depth, meeting(dims, depth, threshold))
    return math.ceil(math.log(1 - CHANCE) / math.log(1 - met)), depth


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in d log d steps."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def bucket_keys(units: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """The buckets of unit vectors: (rows, tables, PROBES) of 64-bit integers, the own bucket first."""
    n, dims = units.shape
    d = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dims] = units
    out = np.empty((n, tables, PROBES), np.uint64)
    rows = np.arange(n)
    for table in range(tables):
        best, second, loss = [], [], []
        for part in range(depth):
            signs = np.random.default_rng((SEED, dims, table, part)).integers(0, 2, (3, d)) * 2.0 - 1
            turned = padded
            for s in signs:
                turned = hadamard(turned * s)
            size = np.abs(turned)
            order = np.argpartition(-size, 2, axis=1)[:, :3] if d > 3 else np.argsort(-size, axis=1)[:, :3]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
            vertex = 2 * order + (np.take_along_axis(turned, order, 1) < 0)
            height = np.take_along_axis(size, order, 1)
            best.append(vertex[:, 0])
            for k in range(1, vertex.shape[1]):
                second.append((part, vertex[:, k]))
                loss.append(height[:, 0] - height[:, k])
        loss = np.stack(loss, axis=1)
        other = np.stack([v for _, v in second], axis=1)
        where = np.array([p for p, _ in second])
        ranked = np.argsort(loss, axis=1, kind="stable")
        own = np.stack(best, axis=1)
        for probe in range(PROBES):
            chosen = own.copy()
            if probe:
                pick = ranked[:, min(probe - 1, ranked.shape[1] - 1)]
                chosen[rows, where[pick]] = other[rows, pick]
            key = np.full(n, (dims << 32) + table, np.uint64)
            for part in range(depth):
                key = K.mix64(key) + chosen[:, part].astype(np.uint64)
            out[:, table, probe] = K.mix64(key)
    return out


def _rows_of(column: pa.Array, dtype: str) -> Iterator[np.ndarray | None]:
    """Each row's vector, or None where it can't link."""
    for value in column.to_pylist():
        if not value or any(v is None for v in value):
            yield None
            continue
        vector = np.array(value, dtype) + np.dtype(dtype).type(0)  # minus zero is zero
        yield vector if np.isfinite(vector).all() and vector.any() else None


def _digests(dtype: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = list(_rows_of(batch.column("embedding"), dtype))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"),
                 pa.array([None if v is None else xxhash.xxh3_128_digest(v.tobytes()) for v in vectors], pa.binary()),
                 pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary()),
                 pa.array([0 if v is None else len(v) for v in vectors], pa.int32())],
                ["vec_id", "digest", "vector", "dims"])
    return digests


def _unit(vectors: list[bytes], dtype: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(vectors), dtype).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(tables: int, depth: int, dtype: str):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                dims = batch.column("dims").to_numpy(zero_copy_only=False)
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    keys = bucket_keys(_unit(part.column("vector").to_pylist(), dtype), tables, depth).reshape(len(part), -1)
                    # a bucket once for each vector, however many probes give it
                    keys = np.sort(keys, axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new].view(np.int64)), part.column("digest").take(pa.array(row))],
                        ["bucket", "digest"])
    return spread


def _first_common(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, by table and key, that rows a and b share; keys: (rows, tables, PROBES)."""
    out = np.zeros(len(a), np.uint64)
    open_ = np.arange(len(a))
    for table in range(keys.shape[1]):
        x, y = keys[a[open_], table], keys[b[open_], table]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        low = np.where(same, x, np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
        hit = same.any(axis=1)
        out[open_[hit]] = low[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


#: Linked rows, and verified pairs, that are counted in one step.
COUNT_ROWS, COUNT_PAIRS = 4096, 1 << 17


class _Counter:
    """Verified pairs of several buckets, counted together: the rows' bucket lists are made anew for all at once."""

    def __init__(self, tables: int, depth: int):
        self.shape = tables, depth
        self._clear()

    def _clear(self) -> None:
        self.digests, self.sizes, self.units, self.pairs, self.rows, self.n_pairs = [], [], [], [], 0, 0

    def add(self, bucket: int, digests: list[bytes], sizes: np.ndarray, units: np.ndarray, a: np.ndarray,
            b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.units and self.units[0].shape[1] != units.shape[1]:
            yield self.flush()
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.digests += [digests[i] for i in used]
        self.sizes.append(sizes[used])
        self.units.append(units[used])
        self.pairs.append((place[:len(a)] + self.rows, place[len(a):] + self.rows, np.full(len(a), bucket, np.int64)))
        self.rows += len(used)
        self.n_pairs += len(a)
        if self.rows >= COUNT_ROWS or self.n_pairs >= COUNT_PAIRS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        """Each row's links that count in its bucket, and its root there."""
        sizes, units = np.concatenate(self.sizes), np.concatenate(self.units)
        a, b, bucket = (np.concatenate(x) for x in zip(*self.pairs))
        counted = _first_common(bucket_keys(units, *self.shape), a, b).view(np.int64) == bucket
        links, root = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        np.add.at(links, a[counted], sizes[b[counted]])
        np.add.at(links, b[counted], sizes[a[counted]])
        while True:  # hook the larger root to the smaller and shorten, until the pairs agree
            p, q = root[a], root[b]
            if (p == q).all():
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while not (root[root] == root).all():
                root = root[root]
        out = pa.RecordBatch.from_arrays([pa.array(self.digests, pa.binary()), pa.array(links),
                                          pa.array([self.digests[i] for i in root], pa.binary())], ["a", "links", "b"])
        self._clear()
        return out


def _verify(threshold: float, tables: int, depth: int, dtype: str):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, part); a group is held while it lasts."""
        counter = _Counter(tables, depth)

        def pairs(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            digests, sizes, side = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
            units = _unit([r[2] for r in rows], dtype)
            within = not side.any()
            left, right = (np.arange(len(rows)),) * 2 if within else (np.flatnonzero(side == 1),
                                                                      np.flatnonzero(side == 2))
            step = max(1, COUNT_PAIRS // max(1, len(right)))
            for lo in range(0, len(left), step):
                a, b = np.nonzero(units[left[lo:lo + step]] @ units[right].T >= threshold)
                a, b = left[lo:lo + step][a], right[b]
                a, b = (a[a < b], b[a < b]) if within else (a, b)
                if len(a):
                    yield from counter.add(bucket, digests, sizes, units, a, b)

        held: list[tuple] = []
        here = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "part", "digest", "size", "vector", "side"))
            for bucket, part, *row in zip(*columns):
                if (bucket, part) != here:
                    if len(held) > 1:
                        yield from pairs(here[0], held)
                    here, held = (bucket, part), []
                held.append(row)
        if len(held) > 1:
            yield from pairs(here[0], held)
        if counter.rows:
            yield counter.flush()

    return verify


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    rows = materialise(vectors.select("vec_id", "embedding").mapInArrow(
        _digests(dtype), f"vec_id {kind}, digest binary, vector binary, dims int"))
    classes = materialise(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"),
        F.first("dims").alias("dims")))
    extent = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
    tables, depth = shape(extent["n"], extent["dims"] or 1, threshold)
    keys = materialise(classes.select("digest", "vector", "dims").mapInArrow(
        _spread(tables, depth, dtype), "bucket long, digest binary"))
    crowded = keys.groupBy("bucket").count().where("count > 1")
    sent = keys.join(crowded, "bucket").join(classes.select("digest", "size", "vector"), "digest")
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    dealt = (sent.withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        (F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own"))).alias("part"),
        F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side")))
    parts = dealt.select("bucket", "digest", "size", "vector", F.explode(others).alias("to")).select(
        "bucket", F.col("to.part").alias("part"), "digest", "size", "vector", F.col("to.side").alias("side"))
    found = materialise(
        parts.repartition(partitions(vectors.sparkSession), "bucket", "part").sortWithinPartitions("bucket", "part")
        .mapInArrow(_verify(threshold, tables, depth, dtype), "a binary, links long, b binary"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = smallest_reachable(found.select("a", "b"))
    label = classes.join(roots, classes["digest"] == roots["node"], "left").select(
        "digest", "least", "size", F.coalesce("root", "digest").alias("root"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = (label.join(least, "root").join(links, label["digest"] == links["a"], "left")
             .select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    out = rows.select("vec_id", "digest").join(facts, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
