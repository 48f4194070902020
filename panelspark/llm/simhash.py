"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at ``distance`` 3 or fewer differing bits.  Two such fingerprints differ in at most one bit
in one of their halves.  Each half is 31 bits and one more, and the anchors are the code words of the Hamming code
[31, 26] with either value of the last bit: a perfect code of covering radius 1, so each half lies within 1 of an anchor.
A fingerprint is sent to every anchor within covering radius plus threshold, 1 + 1 = 2, of either half: 17 anchors at
most.  If two halves differ in at most one bit, the nearest anchor of the one is within 2 of the other, so they meet
there.  (A covering code for all 64 bits would need some ten thousand anchors within 1 + 3 of a fingerprint.)

Equal fingerprints are merged before they are sent.  At an anchor all fingerprints are compared in blocks and those
within the distance are joined to the smallest they reach there, so an anchor gives at most as many links as it has
fingerprints, never all pairs.  An anchor with more than ``BLOCK`` fingerprints is cut into blocks: every pair of
blocks is a task of its own, so a hot anchor is spread out and nothing is left out.  Components are then found by
label propagation over the links (``common.smallest_reachable``).

Defined cases: null and empty texts and texts without words have fingerprint zero and link like others; equal texts and
repeated rows link; rows with a null id link too, but give a component no id: its id is the smallest that is not null
(null if there is none); an empty table gives an empty result.  Other columns are passed over by ``simhash_table`` and
kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import materialise, partitions, small_batches, smallest_reachable

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints of one anchor that are compared in one task.
BLOCK = 4096

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text (UTF-8), as unsigned 64-bit integers."""
    group = K.Texts([t.translate(_LOWER) for t in texts])
    words = group.raw.split()
    _, _, first = group.words()
    # words joined by single spaces: a shingle is then one slice
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    begin = first[:-1].repeat(n_shingles) + np.arange(at[-1]) - at[:-1].repeat(n_shingles)
    last = np.minimum(begin + shingle, first[1:].repeat(n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[begin].tolist(), ends[last].tolist())),
                        np.uint64, int(at[-1]))
    out = np.zeros(len(texts), np.uint64)
    total = np.zeros(len(codes) + 1, np.int32)
    for bit in range(64):
        np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), out=total[1:])
        ones = total[at[1:]] - total[at[:-1]]
        out |= (2 * ones > n_shingles).astype(np.uint64) << np.uint64(bit)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the half, anchor) for all anchors within 2 of 32-bit halves: bits 0-30 are coded, bit 31 is free."""
    word, free = half & np.uint64(0x7FFFFFFF), half >> np.uint64(31)
    syndrome = np.zeros(len(half), np.int64)
    for i in range(31):
        syndrome ^= np.where((word >> np.uint64(i)) & np.uint64(1), i + 1, 0)

    def flipped(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Bit ``position - 1`` flipped; position 0: none."""
        return np.where(position > 0, bits ^ (np.uint64(1) << np.maximum(position - 1, 0).astype(np.uint64)), bits)

    nearest = flipped(word, syndrome)
    index, found = [np.arange(len(half))] * 2, [nearest | free << np.uint64(31),
                                                nearest | (free ^ np.uint64(1)) << np.uint64(31)]
    for i in range(1, 32):  # code words at distance 2: flip i and its complement in the syndrome
        j = syndrome ^ i
        ok = np.flatnonzero((syndrome > 0) & (i < j))
        index.append(ok)
        found.append(flipped(word[ok] ^ (np.uint64(1) << np.uint64(i - 1)), j[ok]) | free[ok] << np.uint64(31))
    return np.concatenate(index), np.concatenate(found)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        for part in np.array_split(prints, max(1, len(prints) // 20_000)):
            for side in (0, 1):
                index, anchor = anchors((part >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((anchor | np.uint64(side << 32)).view(np.int64)), pa.array(part[index].view(np.int64))],
                    ["anchor", "print"])


def _local_links(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``left`` and ``right`` that span the same components as all pairs within the distance."""
    every = np.unique(np.concatenate([left, right]))
    root = np.arange(len(every))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at_right = np.searchsorted(every, right)
    rows = max(1, (1 << 21) // max(1, len(right)))
    for lo in range(0, len(left), rows):
        near = np.bitwise_count(left[lo:lo + rows, None] ^ right[None, :]) <= distance
        a, b = np.nonzero(near)
        at = np.searchsorted(every, left[lo:lo + rows])
        # rows whose partners already share a root need no further step
        a, b = at[a], at_right[b]
        top = root[a] != root[b]
        for i, j in zip(a[top].tolist(), b[top].tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def _compare(distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (anchor, part): one group after another, held only while it lasts."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        here = None

        def close() -> Iterator[pa.RecordBatch]:
            prints, sides = (np.concatenate(x) for x in zip(*held))
            prints = prints.view(np.uint64)
            if len(prints) > 1:
                left, right = (prints, prints) if (sides == 0).all() else (prints[sides == 1], prints[sides == 2])
                a, b = _local_links(np.unique(left), np.unique(right), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                     ["a", "b"])

        for batch in batches:
            anchor, part, prints, side = (batch.column(c).to_numpy(zero_copy_only=False)
                                          for c in ("anchor", "part", "print", "side"))
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(anchor)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                key = (int(anchor[lo]), int(part[lo]))
                if key != here and held:
                    yield from close()
                    held = []
                here = key
                held.append((prints[lo:hi], side[lo:hi]))
        if held:
            yield from close()

    return compare


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``print`` (signed 64-bit) that span their components."""
    n = partitions(prints.sparkSession)
    sent = prints.mapInArrow(_replicate, "anchor long, print long")
    sizes = sent.groupBy("anchor").count().where("count > 1")
    met = sent.join(sizes, "anchor")
    # a hot anchor: blocks by hash; block i meets block j in part (i, j), as left (1) or right (2); i = j: within (0)
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("own", own)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        (F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own"))).alias("part"),
        F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side")))
    parts = dealt.select("anchor", "print", F.explode(others).alias("to")).select(
        "anchor", F.col("to.part").alias("part"), "print", F.col("to.side").alias("side"))
    return (parts.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")
            .mapInArrow(_compare(distance), "a long, b long").distinct())


def _prints(docs: DataFrame, shingle: int, keys: dict) -> DataFrame:
    """(doc_id, keys…, print) of every document, written once."""
    kind, names = docs.schema["doc_id"].dataType.simpleString(), ["doc_id", *keys]
    small_batches(docs.sparkSession)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches):
            prints = fingerprints(K.as_bytes(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints.view(np.int64))],
                                             [*names, "print"])

    rows = docs.select("doc_id", "text", *[c.alias(k) for k, c in keys.items()])
    return materialise(rows.mapInArrow(
        hash_all, f"doc_id {kind}, " + "".join(f"{k} long, " for k in keys) + "print long"))


def _components(hashed: DataFrame, distance: int) -> DataFrame:
    """(print, root, component_id) of every fingerprint: the least one reachable, and the least doc_id reachable."""
    classes = materialise(hashed.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = smallest_reachable(link_fingerprints(classes.select("print"), distance))
    grouped = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "root").select("print", "root", "component_id")


def simhash_table(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every document."""
    hashed = _prints(docs, shingle, {})
    component = _components(hashed, distance).select("print", "component_id")
    return hashed.join(component, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest doc_id (nulls last; among rows of one
    doc_id the choice follows a hash of the row).  Rows that agree in every column count as one."""
    marks = [F.col(f"`{c}`") for c in docs.columns]
    marks += [c.isNull() for c in marks]
    keys = {f"__k{i}": F.xxhash64(F.lit(i), *marks) for i in (1, 2)}  # 128 bits of the whole row
    hashed = _prints(docs, shingle, keys)
    of_print = _components(hashed, distance).select("print", "root")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *keys)).alias("first")
    kept = (hashed.groupBy("print").agg(first).join(of_print, "print")  # a fingerprint's least row, then a component's
            .groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{k}").alias(k) for k in keys]))
    return (docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys))
