"""Token ids of whole texts, as the ``tokenizers`` library gives them, from the ids of their distinct words.

The vocabulary's normaliser and splitter never join characters across white space, nor an ASCII letter with ASCII
punctuation beside it but the apostrophe, and ASCII case is dropped.  So a text's ids are those of its units one after
another (``tests/llm`` compares with the library).  A special token's string is matched before all that: a word that may
hold one is a unit as it is.  A worker keeps the ids of the units that it has met, bounded by ``CACHE_UNITS``, and asks
the library for the others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from panelspark.llm import textkit as K

CACHE_UNITS = 1_000_000
#: Units of letters alone that the library encodes as one text; each gives one token that ends a word.
TOGETHER = 256
VOCABULARY = "word_bpe_49k.json"

_LETTER = K.class_table(bytes([*range(65, 91), *range(97, 123)]))
_MARK = K.class_table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of words; one for each Python worker and vocabulary file (``Encoder.of``)."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the first two bytes of the special tokens' strings
        self.special = sorted({(t.content.encode() * 2)[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted codes of the words
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def ids_of(self, texts: list[str], at_once: int = 64) -> Iterator[np.ndarray]:
        """The library's ids of each text; its own objects live for a few texts at a time."""
        for i in range(0, len(texts), at_once):
            for found in self.tokenizer.encode_batch_fast(texts[i:i + at_once], add_special_tokens=False):
                yield np.array(found.ids, self.dtype)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the words one after another, and how many each has."""
        alpha = np.fromiter((w.isalpha() for w in words), bool, len(words))
        plain, rest = np.flatnonzero(alpha), np.flatnonzero(~alpha)
        parts = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        order, flat, count = [], [], []
        for part, ids in zip(parts, self.ids_of([" ".join([words[i] for i in part]) for part in parts], 8)):
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) != len(part):  # a letter for Python only: one by one
                rest = np.concatenate([rest, part])
                continue
            order.append(part)
            flat.append(ids)
            count.append(np.diff(ends, prepend=-1))
        lists = list(self.ids_of([words[i] for i in rest], 512))
        order.append(rest)
        count.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        flat += lists
        order, flat, count = np.concatenate(order), np.concatenate(flat), np.concatenate(count)
        back = np.argsort(order)
        begin = (np.cumsum(count) - count)[back]
        count = count[back]
        total = np.cumsum(count)
        return flat[np.repeat(begin - (total - count), count) + np.arange(len(flat))], count

    def units(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the units, and the index of each text's first unit (n + 1)."""
        data = texts.data
        gap, letter, mark = K.SPACE[data], _LETTER[data], _MARK[data]
        cut = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        if any(x in texts.raw for x in self.special):
            starts, ends, _ = texts.words()
            at = np.concatenate([np.flatnonzero((data[:-1] == x[0]) & (data[1:] == x[1])) for x in self.special])
            word = np.unique(np.searchsorted(starts, at, side="right") - 1)
            word = word[word >= 0]
            edge = np.zeros(len(data) + 1, np.int64)
            edge[starts[word]] += 1
            edge[ends[word]] -= 1
            whole = np.cumsum(edge[:-1]) > 0
            cut &= ~whole[1:]
            lower = np.where(whole, data, lower)
        starts = np.flatnonzero(np.concatenate([~gap[:1], (gap[:-1] | cut) & ~gap[1:]]))
        ends = np.flatnonzero(np.concatenate([(gap[1:] | cut) & ~gap[:-1], ~gap[-1:]])) + 1
        first = np.searchsorted(starts, np.append(texts.starts, len(data)))
        return starts, ends, K.span_hash(lower, starts, ends), first

    def of_units(self, raw: bytes, starts: np.ndarray, ends: np.ndarray,
                 codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after another, and how many each unit has."""
        distinct, first, place = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_UNITS:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            words = [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            flat, count = self._encode(words)
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, flat])
            self.known = np.insert(self.known, at[new], distinct[new])
            self.begin = np.insert(self.begin, at[new], begin)
            self.count = np.insert(self.count, at[new], count)
            at = np.searchsorted(self.known, distinct)
        begin, count = self.begin[at][place], self.count[at][place]
        total = np.cumsum(count)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.repeat(begin - (total - count), count) + np.arange(n)], count

    def of_texts(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (n + 1)."""
        starts, ends, codes, first = self.units(texts)
        ids, count = self.of_units(texts.raw, starts, ends, codes)
        return ids, np.concatenate([[0], np.cumsum(count)])[first]
