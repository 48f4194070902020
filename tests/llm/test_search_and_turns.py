"""Byte-level encoding, ranked search and conversation repair against the libraries and brute force."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases as C  # noqa: E402

from panelspark.llm import bytebpe, conversations, perfecthash, textkit  # noqa: E402

ROWS = C.edge_documents()


@pytest.fixture(params=[False, True], ids=["plain", "clashing_columns"])
def docs(spark, request):
    return C.documents(spark, extra=request.param)


# --- 12: byte-level encoding

@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(bytebpe.read_ranks(bytebpe.vocabulary_path()), bytebpe.default_pattern())


@pytest.fixture(scope="module")
def own(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_numbers_its_set():
    pick = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 30000):
        codes = np.unique(pick.integers(0, 1 << 63, n).astype(np.uint64) if n > 2 else np.arange(n, dtype=np.uint64))
        made = perfecthash.PerfectHash(codes)
        assert sorted(made.find(codes).tolist()) == list(range(len(codes)))
        other = made.find(textkit.mix64(codes))
        assert ((other >= -1) & (other < max(len(codes), 1))).all()
    with pytest.raises(ValueError):
        perfecthash.PerfectHash(np.array([5, 5], np.uint64))


def test_codec_equals_the_library(codec, own):
    pick = random.Random(1)
    alphabet = [*"abstdreTHE's'.,!|<>$ \n\t0129éÉñİıßſ\x85\x1c\x00_-你好😀�　\xa0½", "՘", "֋", "\U00011de0", " the ",
                "'re", "<|endoftext|>", "   "]
    for _ in range(1500):
        text = "".join(pick.choices(alphabet, k=pick.randint(0, 60)))
        ids = codec.encode([text])[0]
        assert ids.tolist() == own.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()
    for _ in range(60):
        text = "".join(chr(pick.choice([pick.randrange(0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(200))
        assert codec.encode([text])[0].tolist() == own.encode_ordinary(text)


def test_long_texts_are_cut_in_blocks(codec, own, monkeypatch):
    monkeypatch.setattr(bytebpe, "AT_ONCE", 50)
    monkeypatch.setattr(bytebpe, "PIECES", 7)
    monkeypatch.setattr(bytebpe, "CACHE", 5)
    texts = [t or "" for _, t in ROWS if len(t or "") < 5000] + ["", "  \n  x"]
    assert [x.tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert bytebpe.merge(b"a" * 5000, codec.ranks) == own.encode_ordinary("a" * 5000)


def test_byte_level_rows_equal_the_library(docs, own):
    want = []
    for i, text in ROWS:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = C.rows_of(bytebpe.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)


def test_byte_level_ids_and_back(spark, docs, own):
    encoded = bytebpe.encode_texts(docs)
    assert sorted((r.ids for r in encoded.collect())) == sorted(own.encode_ordinary(t or "") for _, t in ROWS)
    back = C.rows_of(bytebpe.decode_ids(encoded), "doc_id", "text")
    assert back == sorted(((i, bytearray((t or "").encode())) for i, t in ROWS), key=repr)
    with pytest.raises(Exception, match="vocabulary lacks"):
        bytebpe.decode_ids(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.encode_decode(none).collect() == [] == bytebpe.decode_ids(bytebpe.encode_texts(none)).collect()


# --- 13: conversations

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """The contract's damage, row by row; rows: (conv_id, turn, role, text)."""
    import zlib

    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(":".join(shown[:2]).encode()) % 20
        role, text = shown[2:]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows, by whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    best = {"": (0, "", ())}  # by the last role's initial: cost, audit, repaired turns

    def follows(before, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[before]

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for before, (c, a, t) in list(ways.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if follows(before, initial):
                        new = (c + 2, a + "I", (*t, role + ":"))
                        ways[initial] = min(ways.get(initial, new), new)
        return ways

    def every(ways):
        """All ways to insert, also those that are not the best for a state."""
        found = [(before, *w) for before, w in ways.items()]
        for _ in range(3):
            found += [(i, c + 2, a + "I", (*t, role + ":")) for before, c, a, t in found
                      for i, role in (("u", "user"), ("a", "assistant")) if follows(before, i)]
        return found

    for _, _, role, text in rows:
        fault = None
        if not text.strip(BLANK):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(BLANK)[-1] not in ".!?":
            fault = "truncated"
        if fault:
            count[fault] += 1
        seen.add((role, text))
        extra = fault == "truncated"
        new: dict = {}
        for before, c, a, t in set(every(best)):
            ways = [(before, c + 3, a + "D", t)]
            if fault not in ("blank", "duplicate"):
                if role[:1] and follows(before, role[:1]):
                    ways.append((role[:1], c + extra, a + "K", (*t, f"{role}:{text}")))
                ways += [(i, c + 2 + extra, a + "R", (*t, f"{r}:{text}")) for i, r in (("u", "user"), ("a", "assistant"))
                         if follows(before, i)]
            for state, *way in ways:
                new[state] = min(new.get(state, tuple(way)), tuple(way))
        best = new
    ends = [w for state, w in inserted(best).items() if state in ("", "a")]
    cost, audit, turns = min(ends)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


def conversation_rows(seed=0):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Fine. ", "a\nb.", "Yes. \x0b"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(pick.randint(0, 9)):
            rows.append((conv, pick.choice([turn, turn, turn, None, turn + 3]),
                         pick.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "u", "User"]),
                         pick.choice(texts) if turn % 2 else f"{conv} {turn}" + pick.choice([".", ",", "?"])))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t % 40}{'.' if t % 7 else ''}") for t in range(300)]
    rows += [(1001, t // 3, ("user", "assistant", "system")[t % 3], f"Turn {t}.") for t in range(150)]
    rows += [(1002, 1, "user", "The same.")] * 90 + [(1002, 1, "assistant", "The other")] * 3
    return rows


def expected(rows, damages=True):
    by: dict = {}
    for conv, turn, role, text in damage(rows) if damages else rows:
        by.setdefault(conv, []).append((conv, turn, role, text))
    return sorted(((c, *repaired(by.get(c, []))) for c in {r[0] for r in rows}), key=repr)


def conversation_table(spark, rows, extra=False):
    names = "conv_id long, turn long, role string, text string"
    if extra:
        names += ", copies string, part int, seg string, `open` string, audit string"
        rows = [(*r, "x", 1, None, "y", "z") for r in rows]
    return spark.createDataFrame(rows, names).repartition(7)


COLUMNS = ("conv_id", *conversations.REPORT)


@pytest.mark.parametrize("extra", [False, True])
def test_conversations_equal_brute_force(spark, extra):
    rows = conversation_rows()
    out = conversations.repair_damaged(conversation_table(spark, rows, extra))
    assert C.rows_of(out, *COLUMNS) == expected(rows)


def test_conversations_over_many_chunks(spark):
    rows = conversation_rows(1)
    made = conversations.repair(conversations.damaged(conversation_table(spark, rows)), "copies", chunk_bytes=60, chunk_rows=5)
    assert made.where("not whole").count() > 100
    assert C.rows_of(conversations.report(made), *COLUMNS) == expected(rows)
    by: dict = {}
    for r in sorted(conversations.turns(made).collect(), key=lambda r: (r.part, r.no, r.at)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.report(made).collect()}
    assert all(hashes[c] == hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in by.items())


def test_crossings_compose_like_one_run():
    pick = random.Random(2)
    for _ in range(300):
        symbols = [pick.choice([0, 1, 2, 3, 4, 5, 6, 7, 4, 6, 4, 6, -1, -3]) for _ in range(pick.randint(0, 30))]
        cost, letters = conversations.solve(symbols)
        cuts = sorted(pick.choices(range(len(symbols) + 1), k=3))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        states = conversations.crossings([conversations.summary(p) for p in parts], 0, None)
        assert letters == "".join(conversations.audit(p, a, b) for p, a, b in zip(parts, states, states[1:])) + \
            conversations.TAIL[states[-1]]
        two = [conversations.compose([conversations.summary(p) for p in x]) for x in (parts[:2], parts[2:])]
        assert conversations.crossings(two, 0, None) == [states[0], states[2], states[4]]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_damaged(none).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "x.", 0)], "conv_id long, turn long, role string, text string, n long")
    assert [tuple(r) for r in conversations.report(conversations.repair(gone, "n")).collect()] == [
        (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- 11: search

def ranked(rows, queries, k=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    import collections
    import math
    import re

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, collections.Counter(term.findall(C.lower(t)))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        asked = collections.Counter(term.findall(C.lower(text)))
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) *
                        ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, times in asked.items() if t in b)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, place + 1, s[3], -s[0]) for place, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def search_rows(seed=0, n=400):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.4)) % 3000}" for _ in range(3000)] + ["Ünï", "x1", "ſ", "你好"]
    rows = [(pick.choice([i, i, i, i % 50, None]), pick.choice([" ", ", ", "-"]).join(pick.choices(vocabulary, k=pick.choice([3, 40, 400]))))
            for i in range(n)]
    rows += [(i + 5000, rows[7][1]) for i in range(30)] + [(9000, None), (9001, ""), (9002, " .,;\x00 ")]
    queries = [(i, " ".join(pick.choices(vocabulary, k=pick.choice([1, 5, 60])))) for i in range(25)]
    queries += [(100, None), (101, "nothingofthis"), (None, rows[7][1]), (3, "w1 w1 W1 x1"), (3, "w1 w1 W1 x1"), (102, "!")]
    return rows, queries


@pytest.mark.parametrize("extra", [False, True])
def test_search_equals_brute_force(spark, extra):
    from panelspark.llm import lexical

    rows, queries = search_rows()
    docs = C.documents(spark, rows, extra)
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, term string").repartition(3)
    out = lexical.search(lexical.build_index(docs), asked)
    assert C.rows_of(out, "item_id", "rank", "doc_id", "score") == ranked(rows, queries)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_over_many_shards_blocks_and_spans(spark, monkeypatch):
    from panelspark.llm import lexical

    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SPAN", 16)
    rows, queries = search_rows(1, 300)
    parts = []
    for i, (lo, hi) in enumerate([(0, 120), (120, 333)]):  # built here, so that the small blocks are in force
        import pyarrow as pa

        shard = lexical._Shard()
        some = rows[lo:hi]
        for at in range(0, len(some), 50):
            shard.add(pa.array([r[0] for r in some[at:at + 50]], pa.int64()),
                      textkit.Texts([(r[1] or "").encode() for r in some[at:at + 50]]))
        parts.append(pa.Table.from_batches(shard.rows(0, i, pa.int64())))
    table = pa.concat_tables(parts).to_pylist()
    heads = [r for r in table if not r["term"]]
    n, total = sum(r["df"] for r in heads), sum(r["occurrences"] for r in heads)
    import collections
    import math

    stats: dict = {}
    for r in table:
        a = stats.setdefault(r["term"], [0, 0, 1 << 40])
        stats[r["term"]] = [a[0] + r["df"], max(a[1], r["max_tf"]), min(a[2], r["min_length"])]
    want = ranked(rows, [q for q in queries if q[0] != 3])
    got = []
    for item, text in queries:
        if item == 3:
            continue
        times = collections.Counter(w for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", C.lower(text)))
        terms = []
        for t, c in times.items():
            if t in stats:
                df, top, low = stats[t]
                w = c * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                terms.append((t, w, w * lexical.impact(top, low, n, total)))
        best = []
        for i, head in enumerate(heads):
            lists = {r["term"]: lexical._Postings(r["blocks"], r["gaps"], r["tfs"]) for r in table
                     if r["term"] and r["shard"] == i}
            best += [(-s, head["ids"][d] is None, head["ids"][d] or 0, head["ids"][d]) for s, d in lexical.best_of_shard(
                lexical._Query("q", terms), lists, np.array(head["lengths"]), n, total, 10)]
        got += [(item, place + 1, b[3], -b[0]) for place, b in enumerate(sorted(best)[:10])]
    assert sorted(got, key=repr) == want
    monkeypatch.undo()
    docs = C.documents(spark, rows)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    out = lexical.search(lexical.build_index(docs, shard_bytes=2000), asked, query_terms=50)
    assert C.rows_of(out, "item_id", "rank", "doc_id", "score") == ranked(rows, queries)


def test_search_without_documents_or_queries(spark):
    from panelspark.llm import lexical

    none = spark.createDataFrame([], "doc_id long, text string")
    nothing = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs in (none, nothing):
        assert lexical.search(lexical.build_index(docs), asked).collect() == []
    some = lexical.build_index(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    assert lexical.search(some, asked.limit(0)).collect() == []
