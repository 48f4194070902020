"""LM scoring by context-tree weighting over binary-decomposed bytes.

The model.  A text is its UTF-8 bytes, lower-cased A-Z, and an end byte.  A byte is eight binary decisions; each decision
(the bits before it in the byte: 255 nodes) has a context tree over the ``DEPTH`` bytes before.  A tree node holds the
counts of zeros and ones that followed its context in the training texts.  Its Krichevsky-Trofimov estimate is weighted,
half and half, with the product of its children's weighted probabilities; the training counts make of that the weight
that each depth has in a prediction.  A byte's probability is the product of its eight mixed predictions, and the score
the log10 probability of the whole text.

Distribution.  All documents are read as groups of a few MB.
1. Each group's distinct (context, byte) strings with their training counts are sent to the bucket of the last two
   context bytes, as compressed columns.  Below depth 2 a tree lies in one bucket, so a task builds its subtrees from
   the counts of all groups.  What they pass up, counts and log probabilities by (last byte, decision), is summed by
   Spark into the nodes of depth 1 and 0: 256 * 255 rows at most, which are broadcast.
2. Each group asks the same buckets for the log probabilities of all its strings, and the buckets of its words' hashes
   for the words' training counts; a bucket answers each group.
3. A group's texts (compressed) and its answers meet, and each text's sums are formed.
Nothing grows with the corpus but the shuffles: hot strings and words are one entry for each group.

Defined cases: a null or empty text has its end alone; rows with a null id (their id as text is empty) train too; rows
with equal id are documents of their own; without training texts every prediction is 1/2 for each bit and the base
counts are zero; an empty table gives an empty result.  Other columns are passed over.  Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import blobs as B
from panelspark.llm import textkit as K
from panelspark.llm.common import materialise, partitions, small_batches

DEPTH = 5
GROUP = 3 << 20
FOLDS, HELD_OUT = 5, 1
#: Bytes that no UTF-8 text has: before a text's start, and its end.
_START, _END = 0xFE, 0xFF
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
GRAMS, WORDS, TEXTS, TOTAL = 0, 1, 2, 3
ROW = "bucket int, kind int, grp binary, keys binary, counts binary"


class Group:
    """Some documents: their texts, which of them train, and a digest that names the group."""

    def __init__(self, ids: list[str], texts: list[bytes]):
        self.train = np.array([zlib.crc32(i.encode()) % FOLDS != HELD_OUT for i in ids], bool)
        self.texts = K.Texts([t.translate(_LOWER) for t in texts])
        self.name = xxhash.xxh3_128_digest(b"\0".join([*map(str.encode, ids), self.texts.raw]))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The string of each byte and end byte (nearest context byte first, then the byte), and its text."""
        sizes = self.texts.sizes + 1 + DEPTH
        n = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        scored = np.ones(n, bool)  # the bytes and end bytes; before each text stand DEPTH start bytes
        data = np.empty(n, np.uint8)
        for k in range(DEPTH):
            scored[begin + k] = False
        data[~scored] = _START
        data[scored] = np.where(self._is_end(), np.uint8(_END), self.texts.data)
        out = np.zeros(n, _U)
        for back in range(1, DEPTH + 1):
            out <<= _U(8)
            out[back:] |= data[:n - back]
        out <<= _U(8)
        out |= data
        return out[scored], np.repeat(np.arange(len(sizes), dtype=np.int32), self.texts.sizes + 1)

    def _is_end(self) -> np.ndarray:
        """Which bytes of the joined texts are the line feeds after a text."""
        end = np.zeros(len(self.texts.data), bool)
        end[self.texts.ends] = True
        return end

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and its text."""
        starts, ends, first = self.texts.words()
        codes = K.span_hash(self.texts.data, starts, ends)
        return codes, np.repeat(np.arange(len(self.texts)), np.diff(first))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Group]]:
    for batch in K.document_groups(batches, max_bytes=GROUP):
        ids = [i or "" for i in batch.column("id_text").to_pylist()]
        yield batch, Group(ids, K.as_bytes(batch.column("text")))


def _gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    pair = grams >> _U(8 * (DEPTH - 1))  # the two nearest context bytes
    return (K.mix64(pair) % _U(buckets)).astype(np.int64)


def _word_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix64(codes ^ _U(0x5851F42D4C957F2D)) % _U(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in the keys' order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["bucket", "kind", "grp", "keys", "counts"])


def _send(buckets: int, asking: bool):
    """Requests: distinct keys with training counts.  ``asking``: all strings and words; else the training strings."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches):
            for kind, found, place in ((GRAMS, group.grams, _gram_bucket), (WORDS, group.words, _word_bucket)):
                if kind == WORDS and not asking:
                    continue
                keys, owner = found()
                train = group.train[owner]
                if not asking:
                    keys, train = keys[train], train[train]
                distinct, place_of = K.distinct(keys)
                counts = np.bincount(place_of[train], minlength=len(distinct)).astype(np.uint32)
                rows = [(b, kind, group.name, B.pack(distinct[at], ascending=True), B.pack(counts[at]))
                        for b, at in _by_bucket(distinct, place(distinct, buckets))]
                if rows:
                    yield _rows(rows)
    return send


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Γ for x > 0: Stirling's series after a shift by 8."""
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    zeros, ones = zeros.astype(float), ones.astype(float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def _segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and each key's run."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def subtrees(grams: np.ndarray, counts: np.ndarray, top: int) -> tuple[dict, np.ndarray]:
    """Context trees of sorted distinct strings down to depth ``top``.

    Returns the nodes of depth ``top`` by (context, decision) → (zeros, ones, log weighted probability) as arrays, and
    the mixed probability of each string's eight bits as seen from depth ``top``: (strings, 8)."""
    levels = [(grams, counts.astype(np.int64), np.arange(len(grams)))]  # depth DEPTH first; row of each string
    for _ in range(DEPTH - top):
        keys, n, row = levels[-1]
        short = (keys >> _U(16)) << _U(8) | (keys & _U(255))  # without the farthest context byte
        upper, place = np.unique(short, return_inverse=True)
        levels.append((upper, np.bincount(place, n, minlength=len(upper)).astype(np.int64), place[row]))
    nodes = {"context": [], "decision": [], "zeros": [], "ones": [], "log": []}
    mixed = np.empty((len(grams), 8))
    for bit in range(8):
        chance = weighted = below = None
        for keys, n, row in levels:
            starts, run = _segments(keys >> _U(8 - bit))
            one = (keys >> _U(7 - bit)) & _U(1) == 1
            ones = np.add.reduceat(np.where(one, n, 0), starts)
            zeros = np.add.reduceat(np.where(one, 0, n), starts)
            estimate = log_kt(zeros, ones)
            node = run[row]
            own = (np.where(one, ones[run], zeros[run]) + 0.5)[row] / (zeros + ones + 1)[node]
            if weighted is None:
                weighted, chance = estimate, own
            else:
                # the children of a node: their decision is the same, their context is longer by a byte
                child = np.zeros(len(weighted), np.int64)
                child[below] = node
                product = np.bincount(child, weighted, minlength=len(starts))
                weighted = np.logaddexp(estimate, product) - math.log(2)
                share = np.exp(estimate - math.log(2) - weighted)[node]
                chance = share * own + (1 - share) * chance
            below = node
        mixed[:, bit] = chance
        keys = levels[-1][0][starts]
        nodes["context"].append(keys >> _U(8))
        nodes["decision"].append(((keys & _U(255)) >> _U(8 - bit)) | _U(1 << bit))
        for name, x in (("zeros", zeros), ("ones", ones), ("log", weighted)):
            nodes[name].append(x)
    return {k: np.concatenate(v) for k, v in nodes.items()}, mixed


def _merge(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all requests, their summed counts, and each request's keys."""
    keys = [B.unpack(k, _U, ascending=True) for _, k, _ in rows]
    flat, n = np.concatenate(keys), np.concatenate([B.unpack(c, np.uint32) for _, _, c in rows])
    order = np.argsort(flat, kind="stable")
    starts, _ = _segments(flat[order])
    return flat[order][starts], np.add.reduceat(n[order].astype(np.int64), starts), keys


def _each_bucket(answer: Callable[[int, int, list], Iterator[pa.RecordBatch]]):
    """Rows sorted by (kind, bucket): call ``answer`` for each bucket, whose compressed rows are held meanwhile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for bucket, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, bucket) != here:
                    if held:
                        yield from answer(*here, held)
                    here, held = (kind, bucket), []
                held.append(row)
        if held:
            yield from answer(*here, held)
    return run


def _tops(kind: int, bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
    """What the subtrees of a bucket pass up to depth 1, by (last byte, decision)."""
    grams, counts, _ = _merge(rows)
    nodes, _ = subtrees(grams, counts, 2)
    last = (nodes["context"] >> _U(8)).astype(np.int64)
    key, place = np.unique(last * 256 + nodes["decision"].astype(np.int64), return_inverse=True)
    sums = [np.bincount(place, nodes[c], minlength=len(key)) for c in ("zeros", "ones", "log")]
    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(s.astype(float)) for s in sums)],
                                     ["node", "zeros", "ones", "log"])


class Root:
    """Depth 1 and 0: for each (last byte, decision) the share of the depth's own estimate and the estimate of a one."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log: np.ndarray):
        z, o, below = (np.zeros(65536) for _ in range(3))
        z[node], o[node], below[node] = zeros, ones, log
        self.share1, self.one1, weighted = self._node(z, o, below)
        z, o, below = (x.reshape(256, 256).sum(axis=0) for x in (z, o, weighted))
        self.share0, self.one0, _ = self._node(z, o, below)

    @staticmethod
    def _node(zeros, ones, below):
        estimate = log_kt(zeros, ones)
        weighted = np.logaddexp(estimate, below) - math.log(2)
        return np.exp(estimate - math.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1), weighted

    def log10(self, grams: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """log10 probabilities of the strings' bytes, from their bits' probabilities as seen from depth 2."""
        byte = (grams & _U(255)).astype(np.int64)
        last = (grams >> _U(8 * DEPTH)).astype(np.int64)
        total = np.zeros(len(grams))
        for bit in range(8):
            decision = (byte >> (8 - bit)) | (1 << bit)
            one = (byte >> (7 - bit)) & 1 == 1
            chance = mixed[:, bit]
            for share, ones, at in ((self.share1, self.one1, last * 256 + decision),
                                    (self.share0, self.one0, decision)):
                own = np.where(one, ones[at], 1 - ones[at])
                chance = share[at] * own + (1 - share[at]) * chance
            total += np.log10(chance)
        return total


def _answers(root):
    def answer(kind: int, bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys, counts, asked = _merge(rows)
        if kind == GRAMS:
            _, mixed = subtrees(keys, counts, 2)
            value = root.value.log10(keys, mixed)
        else:
            value = counts.astype(np.uint32)
            yield _rows([(bucket, TOTAL, b"", B.pack(np.array([(counts > 0).sum(), counts.sum()], np.int64)), b"")])
        for (group, _, _), own in zip(rows, asked):
            part = value[np.searchsorted(keys, own)]
            yield _rows([(bucket, kind, group, B.pack(part.astype(np.float32) if kind == GRAMS else part), b"")])
    return answer


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, group in _groups(batches):
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            raw = out.getvalue().to_pybytes()
        yield _rows([(0, TEXTS, group.name, B.pack_bytes(raw), b"")])


def _score(buckets: int, kind_of_id: pa.DataType):
    """One group's texts and answers → a row for each document; a row of totals for each word bucket."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "known_log", "score", "distinct", "trained"]
    types = [kind_of_id, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def score(key, rows):
        by_kind: dict[int, dict[int, bytes]] = {k: {} for k in (GRAMS, WORDS, TEXTS, TOTAL)}
        copies = 0
        for bucket, kind, _, blob, _ in zip(*(c.to_pylist() for c in rows.columns)):
            copies += kind == TEXTS
            by_kind[kind][bucket] = blob
        if by_kind[TOTAL]:
            sums = np.array([B.unpack(b, np.int64) for b in by_kind[TOTAL].values()]).sum(axis=0)
            empty = [None] * 6
            return pa.table([pa.array([v], t) for v, t in zip([*empty, *map(int, sums)], types)], names=names)
        batch = next(iter(pa.ipc.open_stream(B.unpack_bytes(by_kind[TEXTS][0]))))
        ids = [i or "" for i in batch.column("id_text").to_pylist()]
        group = Group(ids, K.as_bytes(batch.column("text")))
        values = {}
        for kind, found, place, dtype in ((GRAMS, group.grams, _gram_bucket, np.float32),
                                          (WORDS, group.words, _word_bucket, np.uint32)):
            keys, owner = found()
            distinct, inverse = K.distinct(keys)
            value = np.zeros(len(distinct), dtype)
            for b, at in _by_bucket(distinct, place(distinct, buckets)):
                value[at] = B.unpack(by_kind[kind][b], dtype)
            values[kind] = value[inverse], owner
        n = len(ids)
        logs, owner = values[GRAMS]
        total = np.bincount(owner, logs.astype(float), minlength=n)
        counts, owner = values[WORDS]
        columns = [batch.column("doc_id"), ~group.train, np.bincount(owner, minlength=n) + 1,
                   np.bincount(owner, counts > 0, minlength=n).astype(np.int64),
                   np.bincount(owner, np.log10(counts + 0.5), minlength=n), total,
                   pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        one = pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)
        return pa.concat_tables([one] * copies)  # equal groups of rows have one name

    return score


def ctw_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = small_batches(docs.sparkSession)
    n = partitions(spark)
    kind = docs.schema["doc_id"].dataType
    source = docs.select("doc_id", F.col("doc_id").cast("string").alias("id_text"), "text")

    def bucketed(asking: bool) -> DataFrame:
        return (source.mapInArrow(_send(n, asking), ROW).repartition(n, "kind", "bucket")
                .sortWithinPartitions("kind", "bucket"))

    tops = (bucketed(False).mapInArrow(_each_bucket(_tops), "node long, zeros double, ones double, log double")
            .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log"))
            .toPandas())  # 256 * 255 nodes at most
    root = spark.sparkContext.broadcast(Root(*(tops[c].to_numpy() for c in ("node", "zeros", "ones", "log"))))
    answers = bucketed(True).mapInArrow(_each_bucket(_answers(root)), ROW)
    from pyspark.sql.pandas.types import to_arrow_type

    scored = materialise(answers.unionByName(source.mapInArrow(_texts, ROW)).groupBy("grp").applyInArrow(
        _score(n, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, known_log double, score double, "
        "distinct long, trained long"))
    total = scored.agg(F.sum("distinct").alias("v"), F.sum("trained").alias("n"),
                       F.sum(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    ends = total["ends"] or 0  # the end token of each training text
    tokens, distinct = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    return scored.where("held_out IS NOT NULL").select(
        "doc_id", "held_out", F.col("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + math.log10(ends + 0.5) - F.col("n_tokens") * norm).alias("base_score"), "score")
