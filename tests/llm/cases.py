"""Small inputs that every operator must handle, and brute-force versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an ble wh tion er the ou st re ed ha nd à é ß ción ñ".split()

#: Columns whose names the operators use inside; they must pass unharmed.
CLASHES = ("shard", "slot", "bucket", "record", "items", "print", "digest", "removed", "begin", "end", "grp", "kind",
           "length", "__id", "__lane", "text_code", "own_id", "doc", "kept", "component_id", "n_words", "size", "rule")


def words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    made = ["".join(pick.choices(SYLLABLES, k=pick.randint(1, 4))) for _ in range(n)]
    for i in range(9, n, 10):
        made[i] += "."
    return " ".join(made)


def edge_documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, ties, copies, near copies, shared passages, odd characters."""
    base, passage = words(1, 120), words(2, 70)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(10, base), (11, base), (12, near), (13, None), (14, ""), (15, " \n\t \n"), (16, words(3, 40)),
            (17, words(4, 60) + "\n" + passage + "\n" + words(5, 30)), (18, words(6, 50) + "\n" + passage),
            (19, "a" * 30000), (20, "a" * 29999 + "b"), (21, "one two"), (22, words(7, 9000)),
            (23, "line again and again\n" * 40), (24, "x 你好 \u0301 😀 <|endoftext|> it's 3.14%\x00 " * 5),
            (25, words(8, 30) + " " + passage), (26, words(9, 300).upper()),
            (16, words(3, 40)), (10, words(10, 33)), (None, base), (None, None), (None, words(11, 60))]
    return [*rows, *[(100 + i, base) for i in range(30)], *[(200 + i, words(50 + i, 25)) for i in range(30)]]


def documents(spark, rows=None, extra: bool = False):
    rows = edge_documents() if rows is None else rows
    names, kinds = ["doc_id", "text"], ["bigint", "string"]
    if extra:
        rows = [(*r, *[f"{c}{i % 3}" if i % 4 else None for c in CLASHES]) for i, r in enumerate(rows)]
        names, kinds = names + list(CLASHES), kinds + ["string"] * len(CLASHES)
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(rows, schema).repartition(5)


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(rows: list[tuple], length: int = 50) -> list[tuple]:
    """op1: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    rank = [math.inf if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least: dict[bytes, float] = {}
    for r, b in zip(rank, texts):
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            least[s] = min(r, least.get(s, math.inf))
    out = []
    for (i, _), r, b in zip(rows, rank, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < r:
                gone[p:p + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """op5: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    found = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(found) - 7):
        at[tuple(found[i:i + 8])].append(i)
    inside = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    found = WORD.findall(lower(text))
    shingles = [" ".join(found[i:i + shingle]) for i in range(len(found) - shingle + 1)] or \
        ([" ".join(found)] if found else [])
    codes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << bit for bit in range(64)
               if 2 * int(((codes >> np.uint64(bit)) & np.uint64(1)).sum()) > len(codes))


def components(linked: np.ndarray, ids: list) -> list:
    """The smallest id that is not null among all that each row reaches through a square matrix of links."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    tops = [find(i) for i in range(len(ids))]
    least: dict = {}
    for i, t in zip(ids, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [least.get(t) for t in tops]


def base_scores(rows: list[tuple]) -> dict:
    """op4's base columns, by row."""
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(t), sum(count[w] > 0 for w in t), n,
             sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
            for (i, _), t, h in zip(rows, tokens, held)]
