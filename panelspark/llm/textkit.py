"""Vectorised helpers that the operators run inside Spark tasks: groups of texts as one byte array, words, hashes.

A task reads its documents as Arrow batches.  ``document_groups`` cuts them into groups of a few MB, so numpy's
temporaries stay bounded whatever the batch size; a ``Texts`` is one such group, its texts joined by line feeds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one numpy step works on (a longer single text is a group of its own).
GROUP_BYTES = 1 << 20
#: Bytes that are hashed at once where every position gets a 64-bit hash.
HASH_BYTES = 1 << 19

_U = np.uint64
#: Odd multipliers of the polynomial hashes (over bytes, over words) and their inverses modulo 2**64.
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit (splitmix64's finaliser)."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U))


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        base = _BASE[kind]
        size = 1 << max(16, int(n).bit_length())
        up, down = (np.full(size, b, _U) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _powers[kind] = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return have[0][:n], have[1][:n]


class RangeHash:
    """Polynomial hashes modulo 2**64 of the short windows of one sequence of 64-bit codes, from its prefix sums.

    For windows of up to some hundred codes only: whatever the base, two Thue-Morse words of 1,024 codes have one such
    hash (``span_hash`` has no such words)."""

    def __init__(self, codes: np.ndarray, kind: str):
        up, self.down = powers(kind, len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * up[:-1], out=self.prefix[1:])

    def windows(self, k: int) -> np.ndarray:
        """The hashes of all ranges of k codes, by their start."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, _U)
        return mix64((self.prefix[k:] - self.prefix[:n]) * self.down[:n])


def byte_hash(data: np.ndarray) -> RangeHash:
    return RangeHash(_BYTE_CODE[data], "byte")


#: Longer spans are hashed one by one, by the library.
LONG_SPAN = 512
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]`` by its content: eight bytes at a time are mixed into the state of
    all spans that have them; the state begins with the length, so spans of up to eight bytes of one length never
    collide.  Spans over ``LONG_SPAN`` bytes go through XXH3."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
    state = mix64(sizes.astype(_U) + _U(1))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at = starts[live]
    left = sizes[live]
    while len(live):
        state[live] = mix64((state[live] ^ (lanes[at] & _TAIL[np.minimum(left, 8)])) + _U(_BASE["word"]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return state


def class_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = class_table(b" \t\n\x0b\x0c\r")


class Texts:
    """Some texts as one byte array; text i is ``data[starts[i]:ends[i]]`` and a line feed follows each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.sizes = sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte, by text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.ends] - total[self.starts]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (n + 1)."""
        gap = SPACE[self.data]
        before = np.concatenate([[True], gap[:-1]])
        starts = np.flatnonzero(before & ~gap)
        ends = np.flatnonzero(gap & ~before)
        return starts, ends, np.searchsorted(starts, np.append(self.starts, len(self.data)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def document_groups(batches: Iterable[pa.RecordBatch], text: str = "text",
                    max_bytes: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in their order, in groups of about ``max_bytes`` of text (a longer text ends its group)."""
    held: list[pa.RecordBatch] = []
    room = max_bytes
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < batch.num_rows:
            base = int(ends[lo - 1]) if lo else 0
            hi = int(np.searchsorted(ends, base + room, side="left")) + 1  # the row that fills the group is its last
            part = batch.slice(lo, hi - lo)
            held.append(part)
            room -= int(ends[min(hi, batch.num_rows) - 1]) - base
            lo = hi
            if room <= 0:
                yield _whole(held)
                held, room = [], max_bytes
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; hashed, so only distinct keys are sorted."""
    place, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[place]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys
