"""Ranked lexical search: Block-Max MaxScore over sharded inverted lists.

``build_index`` turns documents into shards (``SHARD_BYTES`` of text at most, or one longer text).  A shard's documents are
numbered by ascending id; each of its terms is a row with its postings in blocks of ``BLOCK``: the gaps of the document numbers and
the frequencies, in one byte each where they fit, and for each block its last document, greatest frequency and
least document length.  The index holds every term of every document and answers any queries.

``search`` takes the collection's counts from the index, weighs the queries' terms, and runs each query over each shard: a heap keeps the
k best documents, a term's bound comes from its greatest frequency and least length in the whole collection.  The terms with the
least bounds, whose sum cannot lift a document over the heap's floor, are non-essential: documents are drawn from the other lists
alone.  A document whose score so far plus the block maxima of the non-essential lists stays at or below the floor is rejected before any of
those blocks is unpacked; for the others the lists are read by falling bound, with the rest of the bound checked between.
Documents come in ascending order of id, so one that only equals the floor loses the tie.  The shards' heaps meet in a
window of the k best for each query.  Queries go to the shards in blocks of about ``QUERY_TERMS`` terms, which bounds what is sent to a task.

Defined cases: a null text has no terms and counts as no document; a query without known terms has no rows; repeated query rows give repeated rows
(each with its own ranks, all alike); repeated documents are documents of their own; null doc_ids come last among equal scores; other columns are passed over;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import materialise, small_batches

SHARD_BYTES = 32 << 20
BLOCK = 128
QUERY_TERMS = 100_000
#: Document numbers that are scored at a time.
SPAN = 4096
#: Rows of the index in an Arrow batch.
ROWS = 5000

_TERM = K.class_table(bytes(c for c in range(128) if chr(c).isalnum()) + bytes(range(128, 256)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The terms' pattern for Spark's regular expressions.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# --- scores, in whole numbers

def impact(tf, length, n_docs: int, n_terms: int):
    """What a term of weight 1 gives a document; grows with tf and falls with the length."""
    m = 25 + (75 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- the index

def _terms(texts: K.Texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and of each occurrence its term and its text."""
    data = _LOWER[texts.data]
    inside = _TERM[data]
    inside[texts.ends] = False
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    owner = np.searchsorted(texts.starts, starts, side="right") - 1
    place, found = pd.factorize(K.span_hash(data, starts, ends))  # numbered as they come
    first = np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1)) if len(place) else place
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], place, owner


class _Shard:
    """Documents gathered by a task until they are a shard."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.term: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, texts: K.Texts) -> None:
        found, place, owner = _terms(texts)
        code = np.fromiter((self.code.setdefault(t, len(self.code)) for t in found), np.int64, len(found))
        pair, count = np.unique(code[place] << 32 | owner, return_counts=True)
        self.term.append((pair >> 32).astype(np.int32))
        self.doc.append(((pair & 0xFFFFFFFF) + self.docs).astype(np.int32))
        self.tf.append(count.astype(np.int32))
        self.sizes.append(np.bincount(owner, minlength=len(texts)))
        self.ids.append(ids)
        self.docs += len(texts)
        self.bytes += len(texts.raw)

    def rows(self, part: int, shard: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A head row with the documents (term ``""``), then a row for each term."""
        ids = pa.concat_arrays(self.ids)
        sizes = np.concatenate(self.sizes)
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(self.docs, np.int64)
        number[order] = np.arange(self.docs)
        sizes = sizes[order]
        key = np.concatenate(self.term).astype(np.int64) << 32 | number[np.concatenate(self.doc)]
        tf = np.concatenate(self.tf)
        by = np.argsort(key)
        key, tf = key[by], tf[by]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        head = [pa.array([x], t) for x, t in zip((int((sizes > 0).sum()), int(sizes.sum()), 0, 0, None, None, None), kinds)]
        yield _rows(part, shard, pa.array([""]), head, pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(kind)),
                    pa.array([sizes], pa.list_(pa.int64())))
        if not self.code:
            return
        words = pa.array(list(self.code), pa.binary()).cast(pa.string())
        n = len(words)
        made = _rows(part, shard, words, _lists(key >> 32, key & 0xFFFFFFFF, tf, sizes, n), pa.nulls(n, pa.list_(kind)),
                     pa.nulls(n, pa.list_(pa.int64())))
        for at in range(0, n, ROWS):
            yield made.slice(at, ROWS)


def _lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, sizes: np.ndarray, n: int) -> list[pa.Array]:
    """Of all terms at once, from their postings by (term, document): df, occurrences, greatest tf, least length, the blocks (last
    document, greatest tf, least length), gaps, frequencies."""
    begin = np.searchsorted(term, np.arange(n))
    df = np.diff(begin, append=len(term))
    length = sizes[doc]
    per = -(-df // BLOCK)  # blocks of each term
    upto = np.cumsum(per)
    at = np.repeat(begin, per) + BLOCK * (np.arange(upto[-1]) - np.repeat(upto - per, per))
    last = np.minimum(at + BLOCK, np.repeat(begin + df, per)) - 1
    blocks = np.stack([doc[last], np.maximum.reduceat(tf, at), np.minimum.reduceat(length, at)], axis=1).astype("<i4")
    gaps = np.diff(doc, prepend=0)
    gaps[begin] = doc[begin] + 1
    plain = [df, np.add.reduceat(tf, begin, dtype=np.int64), np.maximum.reduceat(tf, begin), np.minimum.reduceat(length, begin)]
    return [*(pa.array(x.astype(np.int64)) for x in plain), _binary(12 * per, blocks.view(np.uint8).reshape(-1)),
            _narrow(gaps, begin, df), _narrow(tf, begin, df)]


def _binary(size: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _narrow(x: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.Array:
    """Each list's whole numbers in 1, 2 or 4 bytes, after a byte that says which."""
    top = np.maximum.reduceat(x, begin)
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    size = 1 + width * count
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start] = width
    each = np.repeat(width, count)
    at = np.repeat(start + 1 - width * begin, count) + each * np.arange(len(x))
    for byte in range(4):
        some = each > byte
        if byte and not some.any():
            break
        out[at[some] + byte] = (x[some] >> (8 * byte)) & 255
    return _binary(size, out)


_NAMES = ("df", "occurrences", "max_tf", "min_length", "blocks", "gaps", "tfs")


def _rows(part: int, shard: int, words: pa.Array, columns: list[pa.Array], ids: pa.Array, lengths: pa.Array) -> pa.RecordBatch:
    n = len(words)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), words, *columns, ids, lengths],
        ["part", "shard", "term", *_NAMES, "ids", "lengths"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, written once to the shared folder: a row for each shard's documents and each of its terms,
    a shard's rows together."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, of_id = TaskContext.get().partitionId(), 0, _Shard(), None
        for batch in K.document_groups(batches):
            of_id = batch.schema.field("id").type
            ids = batch.column("id")
            held.add(ids, K.Texts(K.as_bytes(batch.column("text"))))
            if held.bytes >= shard_bytes:
                yield from held.rows(part, shard, of_id)
                shard, held = shard + 1, _Shard()
        if held.docs:
            yield from held.rows(part, shard, of_id)

    return materialise(rows.mapInArrow(
        run, f"part int, shard int, term string, df long, occurrences long, max_tf long, min_length long, blocks binary, "
             f"gaps binary, tfs binary, ids array<{kind}>, lengths array<bigint>"))


# --- queries

class _Query(NamedTuple):
    name: str
    terms: list[tuple[str, int, int]]  # term, weight times its repeats, bound of its contribution in the collection


class _Postings:
    """A term's list in a shard."""

    def __init__(self, blocks: bytes, gaps: bytes, tfs: bytes):
        self.last, self.top, self.low = np.frombuffer(blocks, "<i4").reshape(-1, 3).T.astype(np.int64)
        self.before = np.concatenate([[-1], self.last[:-1]])
        self.gaps = np.frombuffer(gaps, f"<u{gaps[0]}", offset=1)
        self.tfs = np.frombuffer(tfs, f"<u{tfs[0]}", offset=1)

    def span(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from lo up to hi, and frequencies."""
        a, b = np.searchsorted(self.last, [lo, hi])  # the block that holds hi may begin before it
        b = min(b + 1, len(self.last))
        if a >= b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = self.before[a] + np.cumsum(self.gaps[a * BLOCK:b * BLOCK], dtype=np.int64)
        x, y = np.searchsorted(docs, [lo, hi])
        return docs[x:y], self.tfs[a * BLOCK + x:a * BLOCK + y].astype(np.int64)

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks, ascending."""
        at = which[:, None] * BLOCK + np.arange(BLOCK)
        there = at < len(self.gaps)
        at = np.where(there, at, 0)
        docs = self.before[which][:, None] + np.cumsum(np.where(there, self.gaps[at], 0), axis=1, dtype=np.int64)
        return docs[there], self.tfs[at[there]].astype(np.int64)


def best_of_shard(query: _Query, lists: dict[str, _Postings], lengths: np.ndarray, n_docs: int, n_terms: int,
                  k: int) -> list[tuple[int, int]]:
    """The k best (score, document number) of a shard, by Block-Max MaxScore."""
    terms = sorted(((bound, weight, lists[t]) for t, weight, bound in query.terms if t in lists), key=lambda x: x[0])
    upto = np.cumsum([0] + [bound for bound, _, _ in terms])  # bounds of the first i lists together
    heap: list[tuple[int, int]] = []
    floor = 0
    for lo in range(0, len(lengths), SPAN):
        hi = min(lo + SPAN, len(lengths))
        skipped = int(np.searchsorted(upto, floor, side="right")) - 1  # lists that are not essential
        if skipped == len(terms):
            break
        total = np.zeros(hi - lo, np.int64)
        for _, weight, postings in terms[skipped:]:
            docs, tf = postings.span(lo, hi)
            total[docs - lo] += weight * impact(tf, lengths[docs], n_docs, n_terms)
        docs = np.flatnonzero((total > 0) & (total + upto[skipped] > floor))
        score, docs = total[docs], docs + lo
        if skipped and len(docs):
            caps, blocks = [], []
            for _, weight, postings in terms[:skipped]:
                at = np.searchsorted(postings.last, docs)
                inside = at < len(postings.last)
                at = np.where(inside, at, 0)
                caps.append(np.where(inside, weight * impact(postings.top[at], postings.low[at], n_docs, n_terms), 0))
                blocks.append(np.where(inside, at, -1))
            caps, blocks = np.stack(caps), np.stack(blocks)
            rest = caps.sum(axis=0)
            for i in reversed(range(skipped)):
                live = score + rest > floor
                docs, score, rest, caps, blocks = docs[live], score[live], rest[live], caps[:, live], blocks[:, live]
                if not len(docs):
                    break
                rest = rest - caps[i]
                wanted = np.unique(blocks[i][blocks[i] >= 0])
                if not len(wanted):
                    continue
                _, weight, postings = terms[i]
                found, tf = postings.blocks(wanted)
                at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
                hit = found[at] == docs
                score = score + np.where(hit, weight * impact(tf[at], lengths[docs], n_docs, n_terms), 0)
        for value, doc in zip(score.tolist(), docs.tolist()):
            if value <= floor:
                continue
            if len(heap) < k:
                heapq.heappush(heap, (value, -doc))
            else:
                heapq.heapreplace(heap, (value, -doc))
            if len(heap) == k:
                floor = heap[0][0]
    return [(value, -doc) for value, doc in heap]


def _searcher(queries: list[_Query], n_docs: int, n_terms: int, k: int):
    names = ["query", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, lengths, lists = None, None, None, {}

        def answers() -> pa.RecordBatch:
            found = [(q.name, doc, score) for q in queries for score, doc in best_of_shard(q, lists, lengths, n_docs, n_terms, k)]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), ids.take(pa.array([f[1] for f in found], pa.int64())),
                 pa.array([f[2] for f in found], pa.int64())], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "shard", "term", "blocks", "gaps", "tfs")]
            for i, (part, shard, term, blocks, gaps, tfs) in enumerate(zip(*columns)):
                if not term:
                    if here is not None:
                        yield answers()
                    here, lists = (part, shard), {}
                    ids = batch.column("ids")[i].values
                    lengths = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                elif (part, shard) != here:
                    raise RuntimeError("a shard's rows are not together")
                else:
                    lists[term] = _Postings(blocks, gaps, tfs)
        if here is not None:
            yield answers()

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", text_col: str = "text",
           query_terms: int = QUERY_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest scores above 0 for each query row, from rank 1 on."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select(F.col(query_id).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    asked = asked.groupBy("id", "text").agg(F.count("*").alias("copies"))
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), F.lit("\n"), "text")
    asked = asked.withColumn("query", F.sha2(named, 256))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = (asked.select("query", F.explode(F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0))).alias("term"))
             .groupBy("query", "term").agg(F.count("*").alias("times")))

    heads = index.where(F.col("term") == "").agg(F.sum("df"), F.sum("occurrences")).first()
    n_docs, n_terms = heads[0] or 0, heads[1] or 0
    found = None
    if n_docs:
        known = (index.where(F.col("term") != "").join(terms.select("term").distinct(), "term")
                 .groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"),
                                      F.min("min_length").alias("min_length")))
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
        weighted = materialise(terms.join(known, "term").select(
            "query", "term", (weight * F.col("times")).alias("weight"), "max_tf", "min_length"))
        for block in range(n_blocks := -(-weighted.count() // query_terms)):
            mine = weighted.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == block).collect()  # about query_terms rows
            by: dict[str, list] = {}
            for r in mine:
                by.setdefault(r.query, []).append(
                    (r.term, r.weight, r.weight * impact(r.max_tf, r.min_length, n_docs, n_terms)))
            wanted = spark.createDataFrame([(t,) for t in sorted({r.term for r in mine} | {""})], "term string")
            lists = index.join(F.broadcast(wanted), "term", "left_semi")  # a bounded block of terms; the rows stay in order
            part = lists.mapInArrow(_searcher([_Query(*q) for q in by.items()], n_docs, n_terms, k),
                                    f"query string, doc_id {kind}, score long")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query string, doc_id {kind}, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = top.join(asked.select("query", "id", "copies"), "query")
    out = out.select("id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(query_id), "rank", "doc_id", "score")
