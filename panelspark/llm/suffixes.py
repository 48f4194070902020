"""Suffix sorting by the difference cover of 3, in vectorised steps.

The suffixes that start at positions 1 and 2 modulo 3 are the sample.  Their triples are sorted and named; the names, those
of the positions 1 modulo 3 followed by those of 2 modulo 3, are a text of two thirds the length, whose suffixes are
sorted by recursion.  The recursion ends when all names differ, or when a name already stands for ``depth`` characters:
a longer common prefix is of no interest.  The remaining suffixes are sorted by their first character and the rank of the
sample suffix after it, and both lists are merged by comparing up to two characters and a sample rank.
"""

from __future__ import annotations

import numpy as np


def _named(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of the rows of equally long columns of small numbers, equal rows sharing one."""
    key = columns[0]
    for column in columns[1:]:
        width = int(column.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + width > 62:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << width) | column
    found, place = np.unique(key, return_inverse=True)
    return place + 1, len(found)


def ranks(text: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """The rank of each suffix of ``text`` (numbers from 1); suffixes with equal first ``depth`` characters are next to
    each other, and may share a rank.  ``span``: characters that a number stands for."""
    n = len(text)
    if n < 4:
        padded = np.concatenate([text, np.zeros(4, text.dtype)])
        return _named(*(padded[k:k + n] for k in range(3)))[0] if n else np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.int64)
    # the first half of the sample must end in a triple with a zero: with n = 1 modulo 3 it takes one more, of zeros
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _named(padded[sample], padded[sample + 1], padded[sample + 2])
    if distinct < len(sample) and 3 * span < depth:
        names = ranks(names, depth, 3 * span)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    rank[n:] = 0
    one, rest = one[one < n], np.arange(0, n, 3)
    both_samples = np.concatenate([one, two])
    width = int(rank.max()).bit_length()
    # the remaining suffixes by their character and the rank after it; sample suffixes at 1 modulo 3 compare with them so
    rest_one, of_one = ((padded[at] << width) | rank[at + 1] for at in (rest, one))
    # those at 2 modulo 3 compare by two characters and the rank after them
    both = np.concatenate([rest, two])
    pair = _named(padded[both], padded[both + 1])[0]
    rest_two, of_two = (pair[:len(rest)] << width) | rank[rest + 2], (pair[len(rest):] << width) | rank[two + 2]
    # merge: a suffix comes after the smaller ones of its own list and of the other
    out = np.zeros(n, np.int64)
    ahead = np.concatenate([[0], np.cumsum(np.bincount(rank[both_samples]))])  # sample suffixes of smaller rank
    by_one, by_two = np.argsort(rest_one), np.argsort(rest_two)
    for at, key, rest_key, by in ((one, of_one, rest_one, by_one), (two, of_two, rest_two, by_two)):
        order, rest_sorted = np.argsort(key), rest_key[by]
        out[at[order]] = ahead[rank[at[order]]] + np.searchsorted(rest_sorted, key[order])
        out[rest[by]] += np.searchsorted(key[order], rest_sorted)
    keys = rest_one[by_one]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    out[rest[by_one]] += np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return out + 1


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, of which the first ``depth`` characters count."""
    return np.argsort(ranks(text.astype(np.int64) + 1, depth), kind="stable")
