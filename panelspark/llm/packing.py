"""Best-fit packing with exact complements.

Pieces of at most ``capacity`` tokens go into as few sequences as possible.  Only the number of pieces of each length
decides, and there are at most ``capacity`` lengths, so the plan is made from that histogram and is bounded whatever the
input.  First with one, then with two, then with three others: from the longest length down, the gap beside a piece is looked up
among the sums of that many available lengths; a combination that fills the gap exactly is consumed as often as its
scarcest length allows.  What is left are residuals: each piece takes the longest length that still fits, again and again
(best fit), also as often as the counts allow.  Each entry of the plan is (lengths of a sequence, how many such
sequences).

Pieces are then numbered inside their length by counts of (length, hash bucket) and their prefix sums, so that a length
that a third of all pieces share is spread over many tasks.  The number of a piece finds its place in the plan, which
is broadcast: it has an entry for each exhausted length, ``PLAN_BOUND`` at most.

Defined cases: a null or empty text is a document with the closing id alone; null ids and repeated rows are documents
like others (equal rows get different places); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import materialise, partitions, small_batches
from panelspark.llm.tokens import Encoder, vocabulary_path

CAPACITY = 4096
CLOSING_ID = 1
#: Entries of a plan: each one exhausts a length (or is the last with its longest length).
PLAN_BOUND = 2 * CAPACITY


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of ``capacity``; the last piece may be shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in K.document_groups(batches):
            ids, first = encoder.of_texts(K.Texts(K.as_bytes(batch.column("text"))))
            ids = ids.astype("<u4")
            row, piece, length, crc = [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[first[i]:first[i + 1]], np.array([closing], "<u4"))
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            start = np.array(piece, np.int64) * capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _pair(total: int, have: np.ndarray, present: np.ndarray, used: int = 0) -> list[int] | None:
    """Two available lengths that sum to ``total``, the longest possible first; one piece of ``used`` is taken."""
    a = present[(present * 2 >= total) & (present < total)]
    b = total - a  # the complements of all lengths at once
    ok = (have[a] - (a == used) > 0) & (have[b] - (b == used) - (a == b) > 0)
    hit = np.flatnonzero(ok)
    return [int(a[hit[-1]]), int(b[hit[-1]])] if len(hit) else None


def _exact(gap: int, parts: int, have: np.ndarray) -> list[int] | None:
    """``parts`` (one to three) available lengths that sum to ``gap``; counts of equal lengths are respected."""
    if parts == 1:
        return [gap] if have[gap] > 0 else None
    present = np.flatnonzero(have[:gap])
    if parts == 2:
        return _pair(gap, have, present)
    for c in present[::-1].tolist():
        if 3 * c < gap:
            break
        rest = _pair(gap - c, have, present[present <= c], c)
        if rest and have[c] > rest.count(c):
            return [c, *rest]
    return None


class _Stock:
    """Pieces left of each length, and the sequences made of the others."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        self.have[list(counts)] = list(counts.values())
        self.made: list[tuple[list[int], int]] = []

    def consume(self, lengths: list[int]) -> None:
        """As many sequences of these lengths as the scarcest allows."""
        each = np.bincount(lengths, minlength=len(self.have))
        used = np.flatnonzero(each)
        times = int((self.have[used] // each[used]).min())
        self.have[used] -= times * each[used]
        self.made.append((lengths, times))

    def fill_exactly(self) -> None:
        capacity = len(self.have) - 1
        if self.have[capacity]:
            self.consume([capacity])
        for parts in (1, 2, 3):
            for longest in range(capacity - 1, 0, -1):
                while self.have[longest] > 0:
                    self.have[longest] -= 1
                    found = _exact(capacity - longest, parts, self.have)
                    self.have[longest] += 1
                    if found is None:
                        break
                    self.consume([longest, *found])

    def best_fit(self) -> list[tuple[list[int], int]]:
        """From the longest down, the longest piece that still fits, again and again."""
        capacity = len(self.have) - 1
        for longest in range(capacity, 0, -1):
            while self.have[longest] > 0:
                left, lengths, free = self.have.copy(), [longest], capacity - longest
                left[longest] -= 1
                while free:
                    fit = np.flatnonzero(left[:free + 1] > 0)
                    if not len(fit):
                        break
                    lengths.append(int(fit[-1]))
                    left[fit[-1]] -= 1
                    free -= int(fit[-1])
                self.consume(lengths)
        return self.made


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, number of sequences): every piece of ``counts`` (length → pieces) is in one sequence.

    Exact combinations, then best fit for the rest; where short pieces are too few for that (most lengths beyond half the
    capacity), best fit for all, if it needs fewer sequences."""
    stock = _Stock(counts, capacity)
    stock.fill_exactly()
    return min(stock.best_fit(), _Stock(counts, capacity).best_fit(), key=lambda made: sum(n for _, n in made))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``."""
    cut = materialise(cut)
    n = partitions(cut.sparkSession)
    spread = max(1, min(1 << 16, 4 * n))
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)).cast("int")
    cut = cut.withColumn("__lane", lane)
    lanes = cut.groupBy("length", "__lane").count()
    counts = {r["length"]: r["n"] for r in lanes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    entries = plan(counts, capacity)
    # the places of each length in plan order: from which number on, in which sequences, at which offset
    places: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in entries:
        offset = 0
        for length in lengths:
            begin = used.get(length, 0)
            places.setdefault(length, []).append((begin, base, offset))
            used[length] = begin + times
            offset += length
        base += times
    keys = np.array([(k << 44) + b for k in sorted(places) for b, _, _ in places[k]], np.int64)
    bases = np.array([s for k in sorted(places) for _, s, _ in places[k]], np.int64)
    offsets = np.array([o for k in sorted(places) for _, _, o in places[k]], np.int64)
    table = cut.sparkSession.sparkContext.broadcast((keys, bases, offsets))

    before = Window.partitionBy("length").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    begins = lanes.select("length", "__lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy("length", "__lane").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("__row", F.row_number().over(inside) - 1).join(begins, ["length", "__lane"])
    columns = [c for c in cut.columns if c not in ("__lane", "sequence_id", "offset")]
    numbered = numbered.select(*columns, (F.col("__begin") + F.col("__row")).cast("long").alias("__number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, offsets = table.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            want = (length.astype(np.int64) << 44) + number
            at = np.searchsorted(keys, want, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(bases[at] + want - keys[at]), pa.array(offsets[at])],
                [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path or vocabulary_path(), capacity), capacity)
