"""Byte-level BPE encoding and decoding of whole texts by a table of ranks, as the ``tiktoken`` library gives them.

A text is cut into pre-tokens by the pattern.  Two tiers give a pre-token's ids.  First a minimal perfect hash of the
vocabulary (``perfecthash``) names the one token that it can be; if the bytes agree, that token is the answer.  A miss is
merged from its bytes: they form a linked list, a heap holds the ranks of neighbouring pairs, and the least rank (leftmost
first) is joined until no pair has one, in n log n steps for n bytes.  A task looks at the distinct pre-tokens of a group of
texts; a worker keeps the ids of missed ones, at most ``CACHE`` of them.  Nothing is shuffled: a text's ids depend on it
alone.

Defined cases: a null text is empty and has no ids; repeated rows give repeated rows; other columns are passed over; an empty
table gives an empty result; ids that the table lacks cannot be decoded (an error).  A text of any length is cut and encoded in
blocks of ``PIECES`` pre-tokens.  Letters and numbers are those of ``tiktoken``'s engine, whose Unicode tables may be older than
Python's.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import small_batches
from panelspark.llm.perfecthash import PerfectHash

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids are looked up at once.
PIECES = 200_000
#: Missed pre-tokens that a worker remembers.
CACHE = 500_000
#: Characters of a text that is cut into pre-tokens in one go.
AT_ONCE = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _ranges(chars: list[str]) -> str:
    """The characters as the inside of a class."""
    codes = np.array([ord(c) for c in chars], np.int64)
    cut = np.flatnonzero(np.diff(codes) != 1)
    pairs = zip(codes[np.concatenate([[0], cut + 1])], codes[np.concatenate([cut, [len(codes) - 1]])])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs)


@cache
def _other_classes() -> dict[str, str]:
    """For ``\\p{L}`` and ``\\p{N}``: the characters on which ``regex`` and the library's engine disagree, as ranges (those
    that only ``regex`` has in the class; its tables are the newer ones)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    plain = {bytes([i]): i for i in range(256)}
    out = {}
    for name in (r"\p{L}", r"\p{N}"):
        engine = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=plain, special_tokens={})
        theirs = set(bytes(engine.encode_ordinary(every)).decode())
        ours = regex.findall(name, every)
        if theirs - set(ours):
            raise RuntimeError(f"the engines disagree on {name} in an unknown way")
        more = [c for c in ours if c not in theirs]
        if more:
            out[name] = _ranges(more)
    return out


class Cutter:
    """Pre-tokens of texts by a pattern, with the classes of the library's engine."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        other = _other_classes()
        self.rare = regex.compile("[" + "".join(other.values()) + "]") if other else None
        if other:
            least = "".join(other.values())
            exact = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{least}]]")
            for name, chars in other.items():
                exact = regex.sub(rf"(?<!\[\^\\s|\[\^\\s\\p\{{L\}}){regex.escape(name)}", lambda _: f"[{name}--[{chars}]]", exact)
            self.exact = regex.compile(exact, regex.V1)
            # bytes that no rare character begins with
            first = min(regex.findall(r"\\U[0-9a-f]{8}", least))
            self.common = bytes(range(chr(int(first[2:], 16)).encode()[0]))

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens in order, some at a time."""
        rare = (self.rare is not None and not text.isascii() and text.encode().translate(None, self.common)
                and self.rare.search(text))
        pattern = self.exact if rare else self.plain
        if len(text) <= AT_ONCE:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while block := list(islice(found, PIECES)):
            yield block


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of rank and place (one integer) over linked bytes."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins at a place ends, which is where the next begins
    before = list(range(-1, n))
    get = ranks.get
    rank_at = [get(piece[i:i + 2], -1) for i in range(n - 1)]  # of the part at a place joined with the next; -1: none
    rank_at.append(-1)
    heap = [rank << 32 | i for i, rank in enumerate(rank_at) if rank >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        rank = pop(heap)
        i = rank & 0xFFFFFFFF
        if rank_at[i] != rank >> 32:
            continue  # one of its parts has been joined since
        middle = after[i]
        end = after[i] = after[middle]
        rank_at[middle] = rank_at[i] = -1
        if end < n:
            before[end] = i
            rank = get(piece[i:after[end]], -1)
            if rank >= 0:
                rank_at[i] = rank
                push(heap, rank << 32 | i)
        if i:
            left = before[i]
            rank = rank_at[left] = get(piece[left:end], -1)
            if rank >= 0:
                push(heap, rank << 32 | left)
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


class Codec:
    """A vocabulary; one for each Python worker, file and pattern (``Codec.of``)."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(read_ranks(path), pattern)
        return cls._made[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cutter = Cutter(pattern)
        tokens = list(ranks)
        codes = self._codes(tokens)
        self.hash = PerfectHash(codes)
        order = np.argsort(self.hash.find(codes))
        self.token_at = [tokens[i] for i in order.tolist()]  # by the perfect hash's number
        self.id_at = np.array([ranks[t] for t in self.token_at], np.int64)
        self.missed: dict[str, bytes] = {}  # as 32-bit integers
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        top = by_id[-1][1] + 1 if by_id else 0
        self.sizes = np.full(top, -1, np.int64)
        self.sizes[[i for _, i in by_id]] = [len(t) for t, _ in by_id]
        self.flat = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        self.begin = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)

    @staticmethod
    def _codes(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and where each begins (n + 1)."""
        code: dict[str, int] = {}
        place = np.fromiter((code.setdefault(p, len(code)) for p in pieces), np.int64, len(pieces))
        found = list(code)
        raw = [p.encode() for p in found]
        at = self.hash.find(self._codes(raw))
        whole = np.fromiter((i >= 0 and self.token_at[i] == p for i, p in zip(at.tolist(), raw)), bool, len(raw))
        count = np.ones(len(raw), np.int64)
        parts: list[bytes] = []
        missed = np.flatnonzero(~whole)
        for i in missed.tolist():
            ids = self.missed.get(found[i])
            if ids is None:
                if len(self.missed) >= CACHE:
                    self.missed.clear()
                ids = self.missed[found[i]] = array("I", merge(raw[i], self.ranks)).tobytes()
            parts.append(ids)
            count[i] = len(ids) >> 2
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), "<u4")
        flat[begin[whole]] = self.id_at[at[whole]]
        if parts:
            size = count[missed]
            done = np.cumsum(size)
            flat[np.repeat(begin[missed] - (done - size), size) + np.arange(int(done[-1]))] = np.frombuffer(b"".join(parts), np.uint32)
        size = count[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(begin[place] - ends[:-1], size) + np.arange(int(ends[-1]))], ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        marks: list[tuple[int, int]] = []

        def flush() -> None:
            ids, ends = self.of_pieces(held)
            at = 0
            for i, n in marks:
                out[i].append(ids[ends[at]:ends[at + n]])
                at += n
            held.clear()
            marks.clear()

        for i, text in enumerate(texts):
            for pieces in self.cutter.blocks(text):
                held += pieces
                marks.append((i, len(pieces)))
                if len(held) >= PIECES:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("an id that the vocabulary lacks")
        size = self.sizes[ids]
        done = np.cumsum(size)
        n = int(done[-1]) if len(done) else 0
        return self.flat[np.repeat(self.begin[ids] - (done - size), size) + np.arange(n)].tobytes()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in K.document_groups(batches):
        yield batch.column("id"), [t.decode(errors="replace") for t in K.as_bytes(batch.column("text"))]


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    rows, kind = _chosen(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for ids, texts in _texts(batches):
            found = pa.array([x.astype(np.int32) for x in codec.encode(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, found], ["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes that the ids stand for; null ids are no ids."""
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            found = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text binary").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text's ids and what they decode to, as digests, in one pass."""
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    rows, kind = _chosen(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for ids, texts in _texts(batches):
            found = codec.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in found], pa.int64()),
                 pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found]),
                 pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
