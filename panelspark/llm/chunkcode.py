"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over ``WINDOW`` bytes cuts the texts into chunks of about ``MEAN`` bytes, so equal passages give equal
chunks wherever they stand.  Each chunk goes to the bucket of its hash, where equal chunks of all documents are encoded
once, each as a text of its own; the ids go back to the groups of documents that asked.  A cut may fall inside a word.
Such a join is repaired: the cut word is encoded again with the whole word before it and the one after it, and the new
ids must agree with both chunks' own ids for these neighbours; then the ids between them replace those of the word's
parts.  A vocabulary for which they do not agree (tokens across white space) is refused with an error.  The ids are
decoded by the library.

Only compressed columns are shuffled: the distinct chunks of each group of a few MB, and their ids.  A chunk that a third
of all documents hold is one entry for each group; buckets grow in number with the shuffle partitions.

Defined cases: a null or empty text has no ids and decodes to the empty text; null ids and repeated rows are rows like
others; a text without white space is one word, whatever its length; strings of special tokens in a text are special
tokens, as in the library; an empty table gives an empty result.  Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from panelspark.llm import blobs as B
from panelspark.llm import textkit as K
from panelspark.llm.common import partitions, small_batches
from panelspark.llm.tokens import Encoder, vocabulary_path

WINDOW, MEAN, LEAST, MOST = 16, 2048, 64, 16384
GROUP = 8 << 20
CHUNKS, PLACES = 0, 1
LEVEL = 6
ROW = "bucket int, kind int, grp binary, body binary, sizes binary"
_NAMES = ["bucket", "kind", "grp", "body", "sizes"]


def cuts(texts: K.Texts) -> list[list[int]]:
    """The bounds of each text's chunks: where the rolling hash says, at characters' starts, LEAST to MOST bytes."""
    data, marks = texts.data, []
    for lo in range(0, len(data), K.HASH_BYTES):
        hashes = K.byte_hash(data[lo:lo + K.HASH_BYTES + WINDOW - 1]).windows(WINDOW)
        marks.append(np.flatnonzero((hashes & np.uint64(MEAN - 1)) == 0) + lo + WINDOW)
    marks = np.concatenate(marks)
    low, high = np.searchsorted(marks, texts.starts + WINDOW), np.searchsorted(marks, texts.ends)
    out = []
    for start, end, lo, hi in zip(texts.starts.tolist(), texts.ends.tolist(), low.tolist(), high.tolist()):
        bounds, at = [start], start
        for mark in [*marks[lo:hi].tolist(), end]:
            while mark - at > MOST or LEAST <= mark - at and mark < end:
                cut = min(mark, at + MOST)
                while cut < end and data[cut] & 0xC0 == 0x80:
                    cut += 1
                if cut >= end:
                    break
                bounds.append(cut)
                at = cut
        if end > start:
            bounds.append(end)
        out.append(bounds)
    return out


def _row(bucket: int, kind: int, group: bytes, body: bytes, sizes: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip((bucket, kind, group, body, sizes),
                                          (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], _NAMES)


def _window(raw: bytes, starts: np.ndarray, ends: np.ndarray, w: int, bounds: list[int], j: int) -> bytes:
    """Word w, first cut at bounds[j], between its neighbours (empty where they are not whole in the chunks at hand)."""
    end, k = int(ends[w]), j
    while bounds[k + 1] < end:  # the chunk in which the word ends
        k += 1
    before = w > 0 and starts[w - 1] >= bounds[j - 1]
    after = w + 1 < len(starts) and ends[w + 1] <= bounds[k + 1]
    return b" ".join([raw[starts[w - 1]:ends[w - 1]] if before else b"", raw[starts[w]:end],
                      raw[starts[w + 1]:ends[w + 1]] if after else b""])


def _cut(buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches, max_bytes=GROUP):
            texts = K.Texts(K.as_bytes(batch.column("text")))
            starts, ends, _ = texts.words()
            raw, known, chunks = texts.raw, {}, []
            refs, counts, joins, windows = [], [], [], []
            for bounds in cuts(texts):
                counts.append(len(bounds) - 1)
                word = np.searchsorted(starts, bounds, side="right") - 1
                inside = [w >= 0 and starts[w] < c < ends[w] for w, c in zip(word.tolist(), bounds)]
                for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    at = known.setdefault(raw[a:b], len(chunks))
                    if at == len(chunks):
                        chunks.append(raw[a:b])
                    refs.append(at)
                    joins.append(inside[j])
                    # a word over several cuts is repaired once, at its first
                    if inside[j] and bounds[j - 1] <= starts[word[j]]:
                        windows.append(_window(raw, starts, ends, int(word[j]), bounds, j))
            name = xxhash.xxh3_128_digest(b"\0".join([texts.raw, *(str(i).encode() for i in
                                                                    batch.column("doc_id").to_pylist())]))
            place = np.fromiter((xxhash.xxh3_64_intdigest(c) % buckets for c in chunks), np.int64, len(chunks))
            order = np.argsort(place, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else ():
                own = [chunks[i] for i in part]
                yield _row(int(place[part[0]]), CHUNKS, name, B.pack_bytes(b"".join(own), LEVEL),
                           B.pack(np.fromiter(map(len, own), np.uint32, len(own))))
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, batch.select(["doc_id"]).schema) as writer:
                writer.write_batch(batch.select(["doc_id"]))
            parts = [ids.getvalue().to_pybytes(), np.array(refs, "<u4").tobytes(), np.array(counts, "<u4").tobytes(),
                     np.array(joins, np.uint8).tobytes(), place.astype("<u4").tobytes(), b"\n".join(windows)]
            yield _row(int.from_bytes(name[:4], "big") % buckets, PLACES, name, B.pack_bytes(b"".join(parts), LEVEL),
                       np.array(list(map(len, parts)), "<u8").tobytes())
    return cut


def _encode(path: str):
    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        asked, known, chunks = [], {}, []
        for _, _, _, body, sizes in held:
            raw, ends = B.unpack_bytes(body), np.cumsum(B.unpack(sizes, np.uint32), dtype=np.int64).tolist()
            own = []
            for a, b in zip([0, *ends], ends):
                chunk = raw[a:b]
                at = known.setdefault(chunk, len(chunks))
                if at == len(chunks):
                    chunks.append(chunk)
                own.append(at)
            asked.append(own)
        ids, facts, lo, size = [], [], 0, 0
        for hi in range(1, len(chunks) + 1):
            size += len(chunks[hi - 1])
            if size < K.GROUP_BYTES and hi < len(chunks):
                continue
            texts = K.Texts(chunks[lo:hi])
            starts, ends, codes, _ = encoder.units(texts)
            flat, count = encoder.of_units(texts.raw, starts, ends, codes)
            begin = np.concatenate([[0], np.cumsum(count)])
            word_starts, _, first = texts.words()
            of_word = begin[np.append(np.searchsorted(starts, word_starts), len(starts))]  # where a word's ids begin
            n = np.diff(first)
            for i in range(hi - lo):
                bounds = of_word[first[i]:first[i + 1] + 1]
                each = np.diff(bounds)
                ids.append(flat[bounds[0]:bounds[-1]].astype(encoder.dtype))
                facts.append((len(ids[-1]), n[i], *(int(each[k]) if n[i] > max(k, -k - 1) else 0
                                                    for k in (0, 1, -2, -1))))
            lo, size = hi, 0
        for (bucket, _, group, _, _), own in zip(held, asked):
            yield _row(bucket, CHUNKS, group, B.pack_bytes(b"".join(ids[i].tobytes() for i in own), LEVEL),
                       B.pack(np.array([facts[i] for i in own], np.uint32).ravel()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (kind, bucket); a bucket's compressed rows are held while it lasts."""
        here, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == PLACES:
                    yield _row(*row)
                    continue
                if row[0] != here:
                    if held:
                        yield from answer(held)
                    here, held = row[0], []
                held.append(row)
        if held:
            yield from answer(held)

    return encode


def _disagree() -> None:
    raise ValueError("the vocabulary's tokens depend on text across white space: a join did not agree")


def _assemble(path: str, kind: pa.DataType):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks"]

    def assemble(key, rows):
        encoder = Encoder.of(path)
        tokenizer, places, answers = encoder.tokenizer, [], {}
        for row in zip(*(c.to_pylist() for c in rows.columns)):
            if row[1] == PLACES:
                places.append(row)
            else:
                answers[row[0]] = row
        raw, sizes = B.unpack_bytes(places[0][3]), np.frombuffer(places[0][4], "<u8")
        ends = np.cumsum(sizes).tolist()
        ids_raw, refs, counts, joins, bucket, windows = (raw[a:b] for a, b in zip([0, *ends], ends))
        doc_ids = next(iter(pa.ipc.open_stream(ids_raw))).column("doc_id")
        refs, counts = np.frombuffer(refs, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist()
        joins, bucket = np.frombuffer(joins, np.uint8).tolist(), np.frombuffer(bucket, "<u4")
        chunk_ids: list = [None] * len(bucket)
        facts: list = [None] * len(bucket)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            row = answers[int(bucket[part[0]])]
            flat = np.frombuffer(B.unpack_bytes(row[3]), encoder.dtype)
            fact = B.unpack(row[4], np.uint32).reshape(-1, 6).astype(np.int64)
            stops = np.cumsum(fact[:, 0]).tolist()
            for i, a, b, f in zip(part.tolist(), [0, *stops], stops, fact.tolist()):
                chunk_ids[i], facts[i] = flat[a:b], f
        words = iter(())
        if windows:
            split = [w.decode() for w in windows.split(b"\n")]
            words = zip(split, encoder.ids_of(split))
        out, at = [], 0
        for count in counts:
            parts = []
            for j in range(count):
                ids, (total, n, n1, n2, m2, m1) = chunk_ids[refs[at + j]], facts[refs[at + j]]
                left, right = joins[at + j], j + 1 < count and joins[at + j + 1]
                if n > 1 or not (left or right):
                    parts.append(ids[n1 if left else 0:total - (m1 if right else 0)])
                if right and not (left and n == 1):
                    # the cut word: encoded with its neighbours, whose ids must be those that the chunks gave
                    window, again = next(words)
                    before, after = not window.startswith(" "), not window.endswith(" ")
                    lead, tail = m2 if before else 0, 0
                    if not np.array_equal(again[:lead], ids[total - m1 - lead:total - m1]):
                        _disagree()
                    if after:
                        k = j + 1
                        while facts[refs[at + k]][1] == 1 and k + 1 < count and joins[at + k + 1]:
                            k += 1
                        other, fact = chunk_ids[refs[at + k]], facts[refs[at + k]]
                        tail = fact[3]
                        if not np.array_equal(again[len(again) - tail:], other[fact[2]:fact[2] + tail]):
                            _disagree()
                    parts.append(again[lead:len(again) - tail])
            at += count
            ids = np.concatenate(parts) if parts else np.zeros(0, encoder.dtype)
            decoded = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
            out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                        hashlib.sha256(decoded.encode()).hexdigest(), count))
        columns = list(zip(*out))
        one = pa.table([doc_ids, *(pa.array(c, t) for c, t in
                                   zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], names=names)
        return pa.concat_tables([one] * len(places))  # equal groups of rows have one name

    return assemble


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chunks of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = path or vocabulary_path()
    n = partitions(small_batches(docs.sparkSession))
    kind = docs.schema["doc_id"].dataType
    sent = docs.select("doc_id", "text").mapInArrow(_cut(n), ROW)
    back = (sent.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket")
            .mapInArrow(_encode(path), ROW))
    return back.groupBy("grp").applyInArrow(
        _assemble(path, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long")
