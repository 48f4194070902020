"""Substring dedup by hashing lines, the sentences of lines, paragraphs, and runs of short units.

Units are the lines of a text and, inside a line of several sentences, its sentences too, so that a passage in the
middle of a longer line is found; and paragraphs (lines between blank ones), so that a paragraph with other line ends is.
Pieces (sentences, and lines of one sentence) that are short are joined: from each piece on, and back from each piece, as
many as hold ``MIN_WORDS`` words.  So every piece of a repeated run of whole pieces goes where the run has that many
words, whatever its pieces have; a short piece alone stays.  A unit is normalised (lower case, runs of white space as one
space) and hashed to 128 bits.  Units under ``MIN_WORDS`` words are left alone.  Digests are grouped globally with partial
aggregates, which keep the earliest occurrence by (doc_id, offset): a digest that a third of all rows share is a row for
each map task only.  Every later occurrence is removed from its text, with the white space that follows it; its original
offsets (in characters) are retained, and those of units that overlap each.

Defined cases: a null text has no units and stays null; null ids rank after all others; rows with equal id and text are
one document (the same units go from each); rows with equal id and different texts are told apart by their text;
a text that only repeats others is empty in the end and stays as a row; an empty table gives an empty result.  Extra
columns of any name are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import small_batches

MIN_WORDS = 8

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![ \t\n]|\Z)[^.!?\n]*)*[.!?]*[ \t]*")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) by start: the lines, each with its line feed, the sentences, with the spaces after them,
    paragraphs of several lines, and the runs of pieces.

    A run that overlaps the first unit of the same words in its own text (a line three times over) has a digest of its
    own, so that the earliest occurrence stays whole."""
    found: list[tuple[int, int, bytes]] = []

    def unit(start: int, end: int, words: list[str]) -> None:
        if len(words) >= min_words:
            found.append((start, end, xxhash.xxh3_128_digest(" ".join(words).encode())))

    pieces: list[tuple[int, int, int, int, list[str]]] = []  # start, end, end of a run from a line's start, line, words
    paragraph: list[str] = []
    at = begin = n_lines = 0
    for number, line in enumerate(text.split("\n")):
        end = at + len(line)
        stop = min(end + 1, len(text))
        cuts = [m.end() for m in _SENTENCE.finditer(text, at, end) if m.end() > m.start()]
        parts = [(a, b, text[a:b].lower().split()) for a, b in zip([at, *cuts], cuts)]
        words = [w for _, _, part in parts for w in part]
        unit(at, stop, words)
        if len(parts) > 1:
            for part in parts:
                unit(*part)
        pieces += [(a, b, stop if b == end else b, number, part) for a, b, part in parts if part]
        if words:
            begin = begin if n_lines else at
            n_lines += 1
            paragraph += words
        if n_lines and (not words or end == len(text)):
            if n_lines > 1:
                unit(begin, stop if words else at, paragraph)
            paragraph, n_lines = [], 0
        at = end + 1

    for i, j in sorted(_runs([len(words) for *_, words in pieces], min_words)):
        start, line = pieces[i][0], pieces[i][3]
        opens, closes = not i or pieces[i - 1][3] < line, j + 1 == len(pieces) or pieces[j + 1][3] > pieces[j][3]
        if not (opens and closes and pieces[j][3] == line):  # else it is the line
            unit(start, pieces[j][2 if opens else 1], [w for *_, words in pieces[i:j + 1] for w in words])

    first: dict[bytes, list[int]] = {}
    for start, end, digest in sorted(found):
        held = first.setdefault(digest, [start, end, 0])
        if held[0] < start < held[1]:
            held[2] += 1
            digest = xxhash.xxh3_128_digest(digest + held[2].to_bytes(4, "little"))
        yield start, end, digest


def _runs(counts: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of two pieces or more that hold ``least`` words, from and back from each."""
    out, total, i = set(), 0, 0
    for j, n in enumerate(counts):
        total += n
        while i < j and total - counts[i] >= least:
            if total - n < least:
                out.add((i, j))  # the run from i on
            total -= counts[i]
            i += 1
        if total >= least and i < j:
            out.add((i, j))  # the run back from j
    return out


def _emit(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches):
            row, start, end, digest = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b, d in units(text or "", min_words):
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    digest.append(d)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_code").take(row), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(digest, pa.binary())],
                ["doc_id", "text_code", "begin", "end", "digest"])
    return emit


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which may overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_code, removed): the spans of each document that an earlier unit has, by start.

    ``text_code`` is ``xxhash64`` of the text; it tells rows of one id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    coded = docs.select("doc_id", "text", F.xxhash64("text").alias("text_code"))
    found = coded.mapInArrow(_emit(min_words),
                             f"doc_id {kind}, text_code long, begin long, end long, digest binary")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "begin")
    earliest = (found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times"))
                .where("times > 1").select("digest", "first"))
    later = found.join(earliest, "digest").where(rank > F.col("first"))
    return later.groupBy("doc_id", "text_code").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("removed"))


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """The documents as a struct column with the spans to remove."""
    spans = repeated_spans(docs, min_words)
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"),
                        F.xxhash64("text").alias("own_code"))
    return whole.join(spans, whole["own_id"].eqNullSafe(spans["doc_id"]) & (whole["own_code"] == spans["text_code"]),
                      "left").select("doc", "removed")


def _texts(batch: pa.RecordBatch) -> tuple[list[str | None], list[list[tuple[int, int]]]]:
    texts = batch.column("doc").field("text").to_pylist()
    spans = [[(s["begin"], s["end"]) for s in r or ()] for r in batch.column("removed").to_pylist()]
    return texts, spans


def dedup_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the kept text, how many characters and units went, and their original offsets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = _texts(batch)
            kept = [t if t is None else cut(t, s) for t, s in zip(texts, spans)]
            gone = [len(t or "") - len(k or "") for t, k in zip(texts, kept)]
            removed = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans],
                               pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").field("doc_id"), pa.array(kept, pa.string()), pa.array(gone, pa.int64()),
                 pa.array(list(map(len, spans)), pa.int64()), removed],
                ["doc_id", "text", "n_chars_removed", "n_units_removed", "removed"])

    return _joined(docs.select("doc_id", "text"), min_words).mapInArrow(
        remove, f"doc_id {kind}, text string, n_chars_removed long, n_units_removed long, "
                f"removed array<struct<begin: long, end: long>>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, ``text`` without what an earlier document (or the same one) has."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = _texts(batch)
            kept = pa.array([t if t is None else cut(t, s) for t, s in zip(texts, spans)], pa.string())
            fields = batch.schema.field("doc").type
            yield pa.RecordBatch.from_arrays(
                [kept if f.name == "text" else batch.column("doc").field(f.name) for f in fields],
                [f.name for f in fields])

    return _joined(docs, min_words).mapInArrow(remove, docs.schema)
