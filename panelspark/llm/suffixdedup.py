"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document of smaller id.

Every string of ``LENGTH`` bytes has an anchor: the least hash among its ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes.  Equal
strings have equal anchors, so strings that match meet at their anchor, and consecutive strings mostly share one: they
are sent together, as the run of bytes that they span (its context).

1. Each group of documents (a few MB) sends its distinct anchors to their buckets, as compressed columns; a bucket
   answers which of them occur in several documents.  Strings of the other anchors match nothing.
2. The contexts of the remaining anchors, each once for a group with its smallest document, are sent to the buckets of
   their anchors.  Equal contexts are merged, so a copied text is one entry however many copies there are.  A bucket
   sorts the suffixes of the contexts that differ but share an anchor with the difference-cover algorithm (``suffixes``:
   sampled triples sorted and named, recursion on the names, merge of the remaining suffixes), and compares adjacent
   prefixes: neighbours with ``LENGTH`` equal bytes are one string.  The smallest document of each string goes back.
3. Each group marks the strings whose smallest document is smaller than its own, and cuts what they cover.

Strings are judged on the input.  Text passes the shuffles compressed and by groups; nothing reaches the driver.  A hot
passage is one context for a group; the buckets' number grows with the shuffle partitions.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a null id counts as larger than all
others, and rows with null ids don't match each other alone; rows with equal ids don't match each other either (neither
id is smaller); an empty table gives an empty result; other columns are passed over.
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
from panelspark.llm.suffixes import suffix_array

LENGTH, GRAM = 50, 25
#: Bits of an anchor that are sent; anchors that agree by chance only cost work, as strings are compared.
ANCHOR_BITS = 48
GROUP = 3 << 20
BUCKETS_PER_PARTITION = 2
#: Bytes of contexts whose suffixes are sorted at a time; the sort's arrays take some hundred times as much.
SLICE = 1 << 19
NO_ID = np.iinfo(np.int64).max
ANCHORS, TEXTS, CONTEXTS, PLACES = 0, 1, 2, 3
ROW = "bucket int, kind int, grp binary, body binary, extra binary"
_NAMES = ["bucket", "kind", "grp", "body", "extra"]


def _row(bucket: int, kind: int, group: bytes, body: bytes, extra: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip((bucket, kind, group, body, extra),
                                          (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], _NAMES)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at each position."""
    out = np.zeros(max(0, len(data) - length + 1), np.uint64)
    for lo in range(0, len(out), K.HASH_BYTES):
        grams = K.byte_hash(data[lo:lo + K.HASH_BYTES + length - 1]).windows(gram)
        out[lo:lo + K.HASH_BYTES] = _sliding_min(grams, length - gram + 1) >> np.uint64(64 - ANCHOR_BITS)
    return out


class Group:
    """Documents of one group and the runs of strings that share an anchor."""

    def __init__(self, ids: pa.Array, texts: list[bytes], length: int, gram: int):
        self.rank = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
        self.texts = K.Texts(texts)
        self.length = length
        self.name = xxhash.xxh3_128_digest(self.rank.tobytes() + self.texts.raw)
        found = anchors(self.texts.data, length, gram)
        count = np.maximum(self.texts.sizes - length + 1, 0)  # strings of each text
        owner = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(owner)) + np.repeat(self.texts.starts - (np.cumsum(count) - count), count)
        value = found[start]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.run_start, self.run_anchor, self.run_owner = start[at], value[at], owner[at]
        self.run_strings = np.diff(np.append(at, len(value)))


def _bucket(found: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix64(found) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[part[0]]), part


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each pair, one after another."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def _split(blob: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u8")).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in K.document_groups(batches, max_bytes=GROUP):
        yield batch.column("doc_id").cast(pa.int64()), K.as_bytes(batch.column("text"))


def _send_anchors(length: int, gram: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _documents(batches):
            group = Group(ids, texts, length, gram)
            distinct = np.unique(group.run_anchor)
            for b, part in _parts(_bucket(distinct, buckets)):
                yield _row(b, ANCHORS, group.name, B.pack(distinct[part], ascending=True))
    return send


def _answer_anchors(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """For each group, which of its anchors another group has too."""
    keys = [B.unpack(body, np.uint64, ascending=True) for _, _, _, body, _ in held]
    ordered = np.sort(np.concatenate(keys))
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    for (bucket, _, group, _, _), own in zip(held, keys):
        if len(twice):
            flags = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
        else:
            flags = np.zeros(len(own), bool)
        yield _row(bucket, ANCHORS, group, np.packbits(flags).tobytes())


def _each_bucket(answer, passed: int):
    """Rows sorted by (kind, bucket): ``answer`` for each bucket's rows; rows of the kind ``passed`` go on as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == passed:
                    yield _row(*row)
                    continue
                if row[0] != here:
                    if held:
                        yield from answer(held)
                    here, held = row[0], []
                held.append(row)
        if held:
            yield from answer(held)
    return run


def _send_texts(length: int, gram: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _documents(batches):
            rank = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
            whole = K.Texts(texts)
            sizes = whole.sizes.astype(np.int64).tobytes()
            yield _row(0, TEXTS, xxhash.xxh3_128_digest(rank.tobytes() + whole.raw), B.pack_bytes(whole.raw, 1),
                       rank.tobytes() + sizes)
    return send


def _open_texts(row: tuple) -> tuple[pa.Array, list[bytes]]:
    numbers = np.frombuffer(row[4], np.int64)
    rank, sizes = numbers[:len(numbers) // 2], numbers[len(numbers) // 2:]
    raw, ends = B.unpack_bytes(row[3]), np.cumsum(sizes + 1) - 1
    texts = [raw[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]
    return pa.array(rank, mask=rank == NO_ID), texts


def _by_kind(rows: pa.Table) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for row in zip(*(c.to_pylist() for c in rows.columns)):
        out.setdefault(row[1], []).append(row)
    return out


def _send_contexts(length: int, gram: int, buckets: int):
    def send(key, rows):
        kinds = _by_kind(rows)
        group = Group(*_open_texts(kinds[TEXTS][0]), length, gram)
        distinct, place = np.unique(group.run_anchor, return_inverse=True)
        flags = np.zeros(len(distinct), bool)
        answers = {row[0]: row[3] for row in kinds.get(ANCHORS, ())}
        for b, part in _parts(_bucket(distinct, buckets)):
            flags[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(part)).astype(bool)
        # and those of several documents of this group
        low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, place, group.rank[group.run_owner])
        np.maximum.at(high, place, group.rank[group.run_owner])
        use = np.flatnonzero((flags | (low != high))[place])
        raw, known, bodies, least = group.texts.raw, {}, [], []
        index = np.empty(len(use), np.int64)
        begin, end = group.run_start[use], group.run_start[use] + group.run_strings[use] + length - 1
        for i, (a, b, r) in enumerate(zip(begin.tolist(), end.tolist(), group.rank[group.run_owner[use]].tolist())):
            body = raw[a:b]
            at = known.setdefault(body, len(bodies))
            if at == len(bodies):
                bodies.append(body)
                least.append(r)
            elif r < least[at]:
                least[at] = r
            index[i] = at
        first = np.zeros(len(bodies), np.int64)
        first[index[::-1]] = np.arange(len(use))[::-1]
        place = _bucket(group.run_anchor[use][first], buckets) if len(bodies) else np.zeros(0, np.int64)
        least = np.array(least, np.int64)
        out = []
        for b, part in _parts(place):
            own = [bodies[i] for i in part]
            sizes = B.pack(np.fromiter(map(len, own), np.uint32, len(own)))
            ranks = B.pack(least[part])
            out.append(_row(b, CONTEXTS, group.name, B.pack_bytes(b"".join(own), 1),
                            len(sizes).to_bytes(4, "little") + sizes + ranks))
        runs = [B.pack(begin.astype(np.uint64), ascending=True), *(B.pack(x.astype(np.uint32)) for x in (
            group.run_strings[use], group.run_owner[use], index, place))]
        out.append(_row(int.from_bytes(group.name[:4], "big") % buckets, PLACES, group.name, b"".join(runs),
                        np.array(list(map(len, runs)), "<u8").tobytes()))
        return pa.Table.from_batches(out)
    return send


def _string_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal strings of ``length`` bytes at the given positions of ``data`` (parted by zeros)."""
    order = suffix_array(data, length)
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = order[wanted[order] >= 0]
    # adjacent prefixes, eight bytes at a time
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data), 8), (1, 1))
    same = np.ones(len(order) - 1, bool)
    for at in sorted({*range(0, max(1, length - 7), 8), max(0, length - 8)}):
        here = words[order + at].copy().view(np.uint64).ravel()
        same &= here[1:] == here[:-1]
    out = np.empty(len(starts), np.int64)
    out[wanted[order]] = np.concatenate([[0], np.cumsum(~same)])
    return out


def _slices(keys: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of equal keys together, of ``SLICE`` bytes at most; a key of more bytes is alone."""
    order = np.argsort(keys, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(keys[order])) + 1, len(order))
    bytes_upto = np.concatenate([[0], np.cumsum(sizes[order])])
    lo = 0
    while lo < len(order):
        fits = int(np.searchsorted(bytes_upto, bytes_upto[lo] + SLICE, side="right")) - 1
        at = int(np.searchsorted(ends, fits, side="right")) - 1
        hi = int(ends[at]) if at >= 0 and ends[at] > lo else int(ends[np.searchsorted(ends, lo, side="right")])
        yield order[lo:hi]
        lo = hi


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbours of about ``SLICE`` bytes."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="left")) + 1
        yield slice(lo, hi)
        lo = hi


def _next_gram(data: np.ndarray, anchor: np.uint64, gram: int) -> np.ndarray:
    """The place of the first gram with the given hash at or after each position."""
    out = np.full(len(data), len(data))
    for lo in range(0, len(data) - gram + 1, K.HASH_BYTES):
        grams = K.byte_hash(data[lo:lo + K.HASH_BYTES + gram - 1]).windows(gram) >> np.uint64(64 - ANCHOR_BITS)
        at = np.flatnonzero(grams == anchor) + lo
        out[at] = at
    return np.minimum.accumulate(out[::-1])[::-1]


def _finer(bodies: list[bytes], anchor: np.uint64, length: int, gram: int, block: int):
    """The runs of strings of some contexts of one anchor whose first gram of that hash is the same and lies at one of
    ``block`` neighbouring offsets, as contexts of their own: texts, keys, numbers of strings, and the context that each
    is from.  The key is what all strings with the gram at these offsets have beside it; equal strings have the gram at
    one offset, so one key."""
    text = K.Texts(bodies)
    count = text.sizes - length + 1
    owner = np.repeat(np.arange(len(count)), count)
    start = _ranges(text.starts, count)
    place = _next_gram(text.data, anchor, gram)[start]
    at_block = (place - start) // block
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]) | (at_block[1:] != at_block[:-1])
    at = np.flatnonzero(new)
    begin, place, at_block, strings = start[at], place[at], at_block[at], np.diff(np.append(at, len(start)))
    last = np.minimum(at_block * block + block - 1, length - gram)
    keys = K.mix64(K.span_hash(text.data, place - at_block * block, place - last + length) + at_block.astype(np.uint64))
    texts = [text.raw[a:b] for a, b in zip(begin.tolist(), (begin + strings + length - 1).tolist())]
    return texts, keys, strings, owner[at]


class _Distinct:
    """Different contexts, in the order in which they came, and the smallest document of each."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.least: list[int] = []

    def add(self, bodies: list[bytes], ranks: list[int]) -> np.ndarray:
        """The number of each context."""
        known, least, out = self.known, self.least, np.empty(len(bodies), np.int64)
        for i, (body, r) in enumerate(zip(bodies, ranks)):
            at = out[i] = known.setdefault(body, len(least))
            if at == len(least):
                least.append(r)
            elif r < least[at]:
                least[at] = r
        return out


def _smallest(bodies: list[bytes], least: np.ndarray, keys: np.ndarray, length: int, gram: int, block: int,
              anchor: np.uint64 | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The smallest document of each string of the contexts, which equal strings can share only at equal keys: places of
    contexts, and the documents of their strings one after another.  ``anchor``: of all, else the keys are the anchors."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    for part in _slices(keys, sizes):
        own = [bodies[i] for i in part]
        if block > 1 and int(sizes[part].sum()) > SLICE:
            yield from _smallest_finer(own, part, least[part], length, gram, -(-block // 2),
                                       keys[part[0]] if anchor is None else anchor)
            continue
        text = K.Texts(own)
        data = text.data.copy()
        data[text.ends] = 0
        count = text.sizes - length + 1
        classes = _string_classes(data, _ranges(text.starts, count), length)
        smallest = np.full(int(classes.max()) + 1, NO_ID)
        np.minimum.at(smallest, classes, np.repeat(least[part], count))
        yield part, smallest[classes]


def _smallest_finer(bodies, part, least, length, gram, block, anchor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_smallest`` for the contexts of one key, by the finer keys of their runs; equal runs are merged."""
    finer, keys, cuts = _Distinct(), [], []
    for piece in _pieces(np.fromiter(map(len, bodies), np.int64, len(bodies))):
        texts, own, strings, owner = _finer(bodies[piece], anchor, length, gram, block)
        had = len(finer.least)
        index = finer.add(texts, least[piece][owner].tolist())
        seen, at = np.unique(index, return_index=True)
        keys.append(own[at[seen >= had]])
        cuts.append((part[piece], index.astype(np.int32), strings.astype(np.int32)))
    texts = list(finer.known)
    counts = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    first = np.cumsum(counts) - counts
    found = np.empty(int(counts.sum()), np.int64)
    for at, values in _smallest(texts, np.array(finer.least, np.int64), np.concatenate(keys), length, gram, block, anchor):
        found[_ranges(first[at], counts[at])] = values
    for at, index, strings in cuts:
        yield at, found[_ranges(first[index], strings)]


def _answer_contexts(length: int, gram: int):
    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        different, asked = _Distinct(), []
        for _, _, _, body, extra in held:
            cut = 4 + int.from_bytes(extra[:4], "little")
            raw, ranks = B.unpack_bytes(body), B.unpack(extra[cut:], np.int64).tolist()
            ends = np.cumsum(B.unpack(extra[4:cut], np.uint32), dtype=np.int64).tolist()
            asked.append(different.add([raw[a:b] for a, b in zip([0, *ends], ends)], ranks))
        bodies, least = list(different.known), np.array(different.least, np.int64)
        del different
        anchor = np.empty(len(bodies), np.uint64)
        for piece in _pieces(np.fromiter(map(len, bodies), np.int64, len(bodies))):
            text = K.Texts(bodies[piece])
            anchor[piece] = anchors(text.data, length, gram)[text.starts]
        # the smallest document of each string of a context, as runs of equal ones: how many runs, and for each the
        # document and the string where it begins; alone at its anchor, a context has strings of its own only
        runs, several = np.ones(len(bodies), np.int64), []
        shared = np.flatnonzero(K.repeated(anchor))
        for part, found in _smallest([bodies[i] for i in shared], least[shared], anchor[shared], length, gram,
                                     length - gram + 1):
            part = shared[part]
            count = np.fromiter((len(bodies[i]) for i in part), np.int64, len(part)) - length + 1
            inside = _ranges(np.zeros(len(part), np.int64), count)
            at = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (inside[1:] == 0)]))
            runs[part] = np.diff(np.searchsorted(at, np.cumsum(count)), prepend=0)
            several.append((part, found[at], inside[at]))
        starts = np.cumsum(runs) - runs
        values, begins = np.repeat(least, runs), np.zeros(int(runs.sum()), np.int64)
        for part, found, inside in several:
            place = _ranges(starts[part], runs[part])
            values[place], begins[place] = found, inside
        for (bucket, _, group, _, _), own in zip(held, asked):
            index = _ranges(starts[own], runs[own])
            parts = [B.pack(runs[own].astype(np.uint32)), B.pack(values[index]), B.pack(begins[index].astype(np.uint32))]
            yield _row(bucket, CONTEXTS, group, b"".join(parts), np.array(list(map(len, parts)), "<u8").tobytes())
    return answer


def _cut(length: int, gram: int, id_type: pa.DataType):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def cut(key, rows):
        kinds = _by_kind(rows)
        ids, bodies = _open_texts(kinds[TEXTS][0])
        texts = K.Texts(bodies)
        rank = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
        places = kinds[PLACES][0]
        begin, strings, owner, index, place = _split(places[3], places[4])
        begin = B.unpack(begin, np.uint64, ascending=True).astype(np.int64)
        strings, owner, index, place = (B.unpack(x, np.uint32).astype(np.int64) for x in
                                        (strings, owner, index, place))
        answers = {row[0]: row for row in kinds.get(CONTEXTS, ())}
        runs, at_run = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        values, begins, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b, part in _parts(place):
            n, v, w = _split(answers[b][3], answers[b][4])
            runs[part] = B.unpack(n, np.uint32)
            at_run[part] = total + np.cumsum(runs[part]) - runs[part]
            values.append(B.unpack(v, np.int64))
            begins.append(B.unpack(w, np.uint32).astype(np.int64))
            total += len(values[-1])
        values, begins = np.concatenate(values), np.concatenate(begins)
        # each run of each occurrence: its strings from ``low`` on, up to the next run or the occurrence's end
        count = runs[index]
        which, at = np.repeat(np.arange(len(index)), count), _ranges(at_run[index], count)
        low = begins[at]
        last = np.concatenate([which[1:] != which[:-1], np.ones(min(1, len(which)), bool)])
        high = np.where(last, strings[which], np.append(low[1:], 0)[:len(low)])
        hit = values[at] < rank[owner[which]]
        edge = np.bincount(begin[which[hit]] + low[hit], minlength=len(texts.data) + 1) - np.bincount(
            begin[which[hit]] + high[hit] + length - 1, minlength=len(texts.data) + 1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = gone & ~np.concatenate([[False], gone[:-1]])
        kept = [hashlib.sha256(texts.data[a:b][~gone[a:b]].tobytes() if gone[a:b].any() else body).hexdigest()
                for a, b, body in zip(texts.starts.tolist(), texts.ends.tolist(), bodies)]
        columns = [ids.cast(id_type), pa.array(texts.sizes, pa.int64()), pa.array(texts.per_text(gone), pa.int64()),
                   pa.array(texts.per_text(spans), pa.int64()), pa.array(kept, pa.string())]
        return pa.concat_tables([pa.table(columns, names=names)] * len(kinds[TEXTS]))  # equal groups have one name

    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document (integer ids)."""
    from pyspark.sql.pandas.types import to_arrow_type

    n = partitions(small_batches(docs.sparkSession))
    buckets = n * BUCKETS_PER_PARTITION
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType

    def bucketed(df: DataFrame) -> DataFrame:
        return df.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket")

    flags = bucketed(source.mapInArrow(_send_anchors(length, gram, buckets), ROW)).mapInArrow(
        _each_bucket(_answer_anchors, PLACES), ROW)
    texts = source.mapInArrow(_send_texts(length, gram), ROW)
    contexts = flags.unionByName(texts).groupBy("grp").applyInArrow(_send_contexts(length, gram, buckets), ROW)
    strings = bucketed(contexts).mapInArrow(_each_bucket(_answer_contexts(length, gram), PLACES), ROW)
    return strings.unionByName(texts).groupBy("grp").applyInArrow(
        _cut(length, gram, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
