"""Operators over documents against brute force, on the cases of ``cases.edge_documents``."""

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases as C  # noqa: E402

from panelspark.llm import (blobs, chunkcode, lm, packing, quality, sharding, simhash, substrings, suffixdedup,  # noqa: E402
                            suffixes, textkit, tokens)

ROWS = C.edge_documents()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.fixture(params=[False, True], ids=["plain", "clashing_columns"])
def docs(spark, request):
    return C.documents(spark, extra=request.param)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# --- 1: suffix-array dedup

def test_suffix_array_sorts_by_prefix():
    pick = np.random.default_rng(0)
    for _ in range(400):
        text = pick.integers(0, pick.integers(1, 6), pick.integers(0, 60)).astype(np.uint8)
        depth = int(pick.choice([1, 3, 5, 9, 20, 1000]))
        order = suffixes.suffix_array(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        found = [bytes(text)[i:i + depth] for i in order]
        assert found == sorted(found)


def test_suffix_dedup_equals_brute_force(docs):
    got = C.rows_of(suffixdedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == C.repeats(ROWS)


def test_suffix_dedup_over_many_groups(spark, monkeypatch):
    """Contexts that meet across groups and inside one, with overlaps of every offset."""
    pick, shared = np.random.default_rng(3), C.words(1, 200)
    rows = []
    for i in range(60):
        a = int(pick.integers(0, len(shared) - 120))
        rows.append((i, C.words(100 + i, 12) + shared[a:a + int(pick.integers(30, 120))] + C.words(200 + i, 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = C.rows_of(suffixdedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == C.repeats(rows)


def _bucket_of(groups, length, gram):
    """The rows of one bucket with the contexts of some groups of (id, text), and for each string its smallest id."""
    import pyarrow as pa

    held, least, strings = [], {}, []
    for at, docs in enumerate(groups):
        group = suffixdedup.Group(pa.array([i for i, _ in docs]), [t for _, t in docs], length, gram)
        bodies, ranks = [], []
        for a, n, owner in zip(group.run_start.tolist(), group.run_strings.tolist(), group.run_owner.tolist()):
            bodies.append(group.texts.raw[a:a + n + length - 1])
            ranks.append(int(group.rank[owner]))
        sizes = blobs.pack(np.array(list(map(len, bodies)), np.uint32))
        held.append((7, suffixdedup.CONTEXTS, b"%d" % at, blobs.pack_bytes(b"".join(bodies)),
                     len(sizes).to_bytes(4, "little") + sizes + blobs.pack(np.array(ranks, np.int64))))
        strings.append([[body[k:k + length] for k in range(len(body) - length + 1)] for body in bodies])
        for own, r in zip(strings[-1], ranks):
            for x in own:
                least[x] = min(r, least.get(x, r))
    return held, [[[least[x] for x in own] for own in group] for group in strings]


@pytest.mark.parametrize("slice_bytes", [400, 5000, 1 << 19])
def test_contexts_of_a_hot_anchor_are_sorted_in_slices(monkeypatch, slice_bytes):
    """One line after many different ones, words repeated at many lengths, and whole copies."""
    pick, length, gram = np.random.default_rng(8), suffixdedup.LENGTH, suffixdedup.GRAM
    line, groups = C.words(5, 12), []
    for g in range(30):
        docs = []
        for j in range(12):
            i = g * 12 + j
            docs.append((int(pick.integers(0, 1000)), "".join([C.words(50 + i % 200, 9), "\n", line, "\n", "the " * int(pick.integers(20, 90)),
                                                              C.words(900 + i, 6)]).encode()))
        groups.append(docs)
    held, want = _bucket_of(groups, length, gram)
    sizes, sort = [], suffixdedup.suffix_array
    monkeypatch.setattr(suffixdedup, "SLICE", slice_bytes)
    monkeypatch.setattr(suffixdedup, "suffix_array", lambda data, depth: (sizes.append(len(data)), sort(data, depth))[1])
    for row, own in zip(suffixdedup._answer_contexts(length, gram)(held), want, strict=True):
        _, _, _, (body,), (extra,) = (c.to_pylist() for c in row.columns)
        n, values, begins = suffixdedup._split(body, extra)
        n, begins = blobs.unpack(n, np.uint32).astype(int), blobs.unpack(begins, np.uint32).astype(int)
        values, at = blobs.unpack(values, np.int64), 0
        for k, least in zip(n.tolist(), own, strict=True):
            assert begins[at] == 0
            high = np.append(begins[at + 1:at + k], len(least))
            assert np.repeat(values[at:at + k], high - begins[at:at + k]).tolist() == least
            at += k
    # with a line feed after each context of at least ``length`` bytes
    assert sizes and max(sizes) <= max(slice_bytes, length) * (length + 1) / length


# --- 3: encoding

def test_units_equal_the_library(library):
    pick = np.random.default_rng(1)
    alphabet = [*"abstdreTHE's'.,!|<>$ \n\t0129éÉñİıßſḰ̇  \x85\x1c\x00_-你好😀\ufffd", "<|endoftext|>", "<|startoftext|>",
                "<|ENDOFTEXT|>", "'s", "'re", " the "]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for _ in range(60):
        texts = ["".join(pick.choice(alphabet, pick.integers(0, 60))) for _ in range(40)]
        ids, first = encoder.of_texts(textkit.Texts([t.encode() for t in texts]))
        for i, text in enumerate(texts):
            assert ids[first[i]:first[i + 1]].tolist() == library_ids(library, text), text


def test_chunk_encoding_equals_the_library(docs, library):
    import hashlib

    want = []
    for i, text in ROWS:
        ids = library_ids(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    got = C.rows_of(chunkcode.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)


def test_chunk_joins_with_very_short_chunks(spark, library, monkeypatch):
    """Cuts nearly everywhere: words over several chunks, chunks without white space."""
    for name, value in (("WINDOW", 2), ("MEAN", 2), ("LEAST", 1), ("MOST", 5)):
        monkeypatch.setattr(chunkcode, name, value)
    texts = [t for _, t in ROWS if t and len(t) < 3000] + ["é" * 40, "ab" * 30 + " c " + "你" * 9]
    import pyarrow as pa

    def batches(df_rows):
        yield pa.RecordBatch.from_arrays([pa.array(range(len(df_rows))), pa.array(df_rows)], ["doc_id", "text"])

    sent = list(chunkcode._cut(3)(batches(texts)))
    ordered = sorted((r for b in sent for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[1], r[0]))
    as_batches = [chunkcode._row(*r) for r in ordered]
    back = list(chunkcode._encode(tokens.vocabulary_path())(iter(as_batches)))
    from pyspark.sql.types import LongType  # noqa: F401
    out = chunkcode._assemble(tokens.vocabulary_path(), pa.int64())(None, pa.Table.from_batches(back))
    assert out.column("n_tokens").to_pylist() == [len(library_ids(library, t)) for t in texts]
    import hashlib
    assert out.column("ids_sha256").to_pylist() == [
        hashlib.sha256(np.array(library_ids(library, t), "<u4").tobytes()).hexdigest() for t in texts]


def test_equal_passages_give_equal_chunks():
    shared = C.words(5, 2000).encode()
    texts = textkit.Texts([b"left " + shared, C.words(6, 77).encode() + b" " + shared])
    a, b = [[texts.raw[x:y] for x, y in zip(c, c[1:])] for c in chunkcode.cuts(texts)]
    assert len(set(a) & set(b)) >= len(a) - 3
    assert b"".join(a) == texts.raw[:texts.ends[0]]


# --- 4: scoring

def test_base_scores_and_ctw_rows(docs):
    out = lm.ctw_scores(docs).collect()
    want = sorted(C.base_scores(ROWS), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(r.score < 0 for r in out)


def ctw_brute(train: list[bytes], text: bytes, depth: int) -> float:
    """log10 probability by the definition: trees as dictionaries, weighted probabilities by recursion."""
    counts: dict = {}

    def decisions(data: bytes):
        data = bytes([lm._START]) * depth + data + bytes([lm._END])
        for i in range(depth, len(data)):
            context = data[i - depth:i][::-1]
            for bit in range(8):
                yield context, (1 << bit) | data[i] >> (8 - bit), data[i] >> (7 - bit) & 1

    children: dict = {}
    for data in train:
        for context, node, one in decisions(data):
            for d in range(depth + 1):
                counts.setdefault((context[:d], node), [0, 0])[one] += 1
                if d < depth:
                    children.setdefault((context[:d], node), set()).add(context[:d + 1])

    def kt(z, o):
        return math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)

    memo: dict = {}

    def weighted(context, node):
        key = (context, node)
        if key not in memo:
            own = kt(*counts.get(key, (0, 0)))
            memo[key] = own if len(context) == depth else np.logaddexp(
                own, sum(weighted(c, node) for c in children.get(key, ()))) - math.log(2)
        return memo[key]

    total = 0.0
    for context, node, one in decisions(text):
        chance = None
        for d in range(depth, -1, -1):
            at = (context[:d], node)
            zeros, ones = counts.get(at, (0, 0))
            own = ((ones if one else zeros) + .5) / (zeros + ones + 1)
            share = 1.0 if d == depth else math.exp(kt(zeros, ones) - math.log(2) - weighted(*at))
            chance = own if chance is None else share * own + (1 - share) * chance
        total += math.log10(chance)
    return total


def test_ctw_equals_its_definition(spark):
    import zlib

    rows = [(i, C.words(i, 12)) for i in range(40)] + [(90, None), (91, "aaaaaaaaaa"), (92, "Aaaaa")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in lm.ctw_scores(df).collect()}
    texts = {i: C.lower(t).encode() for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    for i in (0, 3, 4, 17, 90, 91, 92):
        assert got[i] == pytest.approx(ctw_brute(train, texts[i], lm.DEPTH), rel=1e-5)


def test_blobs_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (blobs.unpack(blobs.pack(x, ascending=True), np.uint64, ascending=True) == x).all()
    assert len(blobs.unpack(blobs.pack(np.zeros(0, np.uint32)), np.uint32)) == 0


# --- 5: quality rules

def test_quality_base_equals_brute_force(docs):
    out = quality.quality_table(docs, quality.all_content()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(((r.doc_id, *(r[c] for c in names), r.base_failed, r.kept) for r in out), key=repr)
    want = []
    for i, text in ROWS:
        base = C.quality(text)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        want.append((i, *base, failed, not failed))  # the field marks all content
    assert got == sorted(want, key=repr)


def test_viterbi_finds_the_best_labels():
    import itertools

    pick = np.random.default_rng(2)
    for _ in range(30):
        lengths = pick.integers(1, 7, 4)
        owner = np.repeat(np.arange(4), lengths)
        features = pick.normal(size=(len(owner), 3))
        field = quality.Field(pick.normal(size=3), float(pick.normal()), pick.normal(size=(2, 2)))
        got, at = quality.viterbi(field, owner, features), 0
        for n in lengths:
            emit = features[at:at + n] @ field.weights

            def score(labels):
                return (field.start * labels[0] + sum(e for e, s in zip(emit, labels) if s)
                        + sum(field.move[a, b] for a, b in zip(labels, labels[1:])))
            best = max(itertools.product((0, 1), repeat=int(n)), key=score)
            assert score(tuple(got[at:at + n].tolist())) == pytest.approx(score(best))
            at += n


def test_training_reaches_the_most_likely_field():
    """No step in any weight makes the labels of short chains more likely (all labellings are summed)."""
    import itertools

    pick = np.random.default_rng(4)
    owner = np.repeat(np.arange(300), 6)
    labels = np.repeat(pick.integers(0, 2, 600), 3)
    features = np.stack([labels + pick.normal(0, .6, len(labels)), np.ones(len(labels))], axis=1)
    field = quality.train(owner, features, labels, steps=400)
    every = np.array(list(itertools.product((0, 1), repeat=6)))

    def likelihood(theta):
        emit = (features @ theta[:2]).reshape(300, 6)
        move = theta[3:].reshape(2, 2)
        score = emit @ every.T + theta[2] * every[:, 0] + move[every[:, :-1], every[:, 1:]].sum(axis=1)
        mine = labels.reshape(300, 6)
        own = (emit * mine).sum(axis=1) + theta[2] * mine[:, 0] + move[mine[:, :-1], mine[:, 1:]].sum(axis=1)
        return (own - np.logaddexp.reduce(score, axis=1)).mean() - 0.5e-3 * (theta ** 2).sum()

    best = np.concatenate([field.weights, [field.start], field.move.ravel()])
    for k in range(len(best)):
        for step in (-0.2, 0.2):
            other = best.copy()
            other[k] += step
            assert likelihood(best) > likelihood(other) - 1e-4
    assert (quality.viterbi(field, owner, features) == labels).mean() > 0.83


def test_quality_keeps_clean_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    verdict = quality.quality_table(documents, quality.fit(documents, labels)).join(labels, "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in verdict.where("not base_failed").groupBy("quality", "kept").count()
             .collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True]
    assert found.get((0, True), 0) <= 0.2 * found[0, False]


def test_fit_without_labels_keeps_all(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = quality.fit(C.documents(spark), labels)
    assert field.weights.tolist() == quality.all_content().weights.tolist()


# --- 6: SimHash

def test_fingerprints_and_components(docs):
    got = C.rows_of(simhash.simhash_table(docs), "doc_id", "fingerprint", "component_id")
    prints = [C.fingerprint(t) for _, t in ROWS]
    near = np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)[None]) <= 3
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(ROWS, prints, C.components(near, [i for i, _ in ROWS]))]
    assert got == sorted(want, key=repr)


def test_anchors_cover_every_pair_within_one_bit():
    pick = np.random.default_rng(0)
    half = pick.integers(0, 2**32, 300).astype(np.uint64)

    def sets(x):
        index, anchor = simhash.anchors(x)
        out = [set() for _ in x]
        for i, a in zip(index.tolist(), anchor.tolist()):
            out[i].add(a)
        return out

    own = sets(half)
    for bit in range(32):
        other = sets(half ^ np.uint64(1 << bit))
        assert all(a & b for a, b in zip(own, other))
    assert max(map(len, own)) <= 17


@pytest.mark.parametrize("block", [4096, 5])
def test_links_span_all_components(spark, block):
    """Clouds of fingerprints around centres, with hot anchors cut into blocks."""
    pick = np.random.default_rng(5)
    values = []
    for centre in pick.integers(0, 2**63, 12).astype(np.uint64):
        for _ in range(25):
            flips = np.bitwise_or.reduce(np.uint64(1) << pick.integers(0, 64, 3).astype(np.uint64))
            values.append(int(centre ^ flips))
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values} | {0, 7, 15, -1})
    df = spark.createDataFrame([(v,) for v in values], "print long")
    links = {(r.a, r.b) for r in simhash.link_fingerprints(df, block=block).collect()}
    x = np.array(values, np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    made = np.zeros_like(near)
    place = {v: i for i, v in enumerate(values)}
    for a, b in links:
        made[place[a], place[b]] = True
    assert C.components(made, values) == C.components(near, values)


def test_one_document_of_each_group_stays(docs):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 10 in ids and 11 not in ids and 100 not in ids and 16 in ids
    prints = np.array([C.fingerprint(t) for _, t in ROWS], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert len(ids) == len(set(C.components(near, list(range(len(ROWS))))))


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(i, C.words(900 + i, 60)) for i in range(50)]
    rows += [(7, C.words(990, 60)), (None, C.words(991, 60)), (None, C.words(991, 60)), (None, None), (None, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(4)).collect()
    texts = sorted(r.text or "" for r in kept)
    assert texts == sorted([t for i, t in rows if t][:52] + [""])


def test_fit_reads_lines_from_anywhere(spark):
    """Boilerplate that stands at the end of long documents only is learnt."""
    rows, labels = [], []
    for i in range(60):
        body = [C.words(2000 + 40 * i + j, 14) for j in range(40)]
        rows += [(i, "\n".join(body + ["| # | $ | % | & | # |"] * 40 * (i % 2)))] * (3 if i == 1 else 1)
        labels.append((i, 1 - i % 2))
    field = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                        spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = textkit.Texts([rows[0][1].encode(), "\n".join(["| # | $ | % | & | # |"] * 30).encode()])
    base, lines = quality.measure(texts)
    marks = quality.viterbi(field, lines.text, lines.features)
    assert marks[lines.text == 0].mean() < 0.1 and marks[lines.text == 1].mean() > 0.9


# --- 7: substring dedup

def brute_units(rows, min_words=substrings.MIN_WORDS):
    def rank(i, start):
        return i is None, i or 0, start

    found = [(i, t, list(substrings.units(t or "", min_words))) for i, t in rows]
    first: dict = {}
    for i, _, units in found:
        for a, _, d in units:
            first[d] = min(first.get(d, rank(i, a)), rank(i, a))
    out = []
    for i, t, units in found:
        spans = [(a, b) for a, b, d in units if rank(i, a) > first[d]]
        out.append((i, None if t is None else "".join(c for k, c in enumerate(t)
                                                        if not any(a <= k < b for a, b in spans))))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(docs):
    rows = [(i, t) for i, t in ROWS]
    assert C.rows_of(substrings.dedup_table(docs), "doc_id", "text") == brute_units(rows)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    assert C.rows_of(out, "doc_id", "text") == brute_units(rows)
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    assert C.rows_of(out, "doc_id", *extra) == C.rows_of(docs, "doc_id", *extra)


def test_substring_offsets_lead_back_to_the_text(spark):
    texts = dict(r for r in ROWS if r[0] is not None and r[0] not in (10, 16))
    for r in substrings.dedup_table(C.documents(spark, list(texts.items()))).collect():
        spans = [(s.begin, s.end) for s in r.removed]
        assert substrings.cut(texts[r.doc_id] or "", spans) == (r.text or "")
        assert len(texts[r.doc_id] or "") - len(r.text or "") == r.n_chars_removed


def test_a_passage_inside_longer_lines_goes(spark):
    passage = ". ".join(C.words(i, 12).replace(".", "") for i in range(6)) + "."
    rows = [(1, f"Alone here. {passage} And more of it."), (2, f"Other words. {passage} The end is near.")]
    out = {r.doc_id: r.text for r in substrings.dedup_table(C.documents(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "Other words. The end is near."


def test_repeated_runs_of_short_units_go(spark):
    pick = np.random.default_rng(5)
    short = [" ".join(f"w{x}" for x in pick.integers(0, 900, 4)) for _ in range(16)]
    speech, verse = ". ".join(short) + ".", "\n".join(short)
    wrapped = " ".join(short).replace("w", "v").split()
    fold = lambda n: "\n".join(" ".join(wrapped[i:i + n]) for i in range(0, 64, n))
    rows = [(1, f"Alone. {speech} End."), (2, f"Other. {speech} Ends."), (3, f"Top\n{verse}\nlow"), (4, f"Cap\n{verse}\nsole"),
            (5, f"A b.\n\n{fold(5)}\n\nc d."), (6, f"E f.\n\n{fold(3)}\n\ng h."), (7, "New. Alone. Then."),
            (8, "One two three four.\n" * 3), (9, "six words of it before this. " + short[2] + ". After.")]
    out = {r.doc_id: r.text for r in substrings.dedup_table(C.documents(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "Other. Ends." and out[3] == rows[2][1] and out[4] == "Cap\nsole"
    assert out[5] == rows[4][1] and out[6] == "E f.\n\n\ng h."
    assert out[7] == rows[6][1] and out[8] == rows[7][1] and out[9] == rows[8][1]


@pytest.mark.parametrize("least", [1, 8])
def test_runs_cover_every_repeated_run(least):
    pick = np.random.default_rng(6)
    for _ in range(200):
        counts = [int(n) for n in pick.choice([1, 2, 3, 5, 9], pick.integers(1, 12))]
        runs = {(i, j) for i, j in substrings._runs(counts, least)} | {(i, i) for i, n in enumerate(counts) if n >= least}
        assert all(sum(counts[i:j + 1]) >= least for i, j in runs)
        for p in range(len(counts)):
            for q in range(p, len(counts)):
                inside = {k for i, j in runs if p <= i and j <= q for k in range(i, j + 1)}
                assert inside == (set(range(p, q + 1)) if sum(counts[p:q + 1]) >= least else set())


# --- 8: sharding

def test_shards_hold_every_row_once(docs):
    out = sharding.shard_documents(docs, bucket_bytes=2000).collect()
    import zlib

    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    sizes = np.bincount([r.shard for r in out], minlength=8)
    assert sizes.max() - sizes.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))


def test_the_digest_rows_come_from_written_whole_records(spark):
    from panelspark.session import checkpoint_dir

    df = spark.range(300).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text", "id % 7 as more")
    out = sharding.shard_documents(df, bucket_bytes=5000)
    path = {os.path.dirname(os.path.dirname(f)) for f in out.inputFiles()}
    assert len(path) == 1 and path.pop().removeprefix("file://").startswith(checkpoint_dir(spark).removeprefix("file://"))
    files = [f.removeprefix("file://") for f in out.inputFiles()]
    written = spark.read.option("basePath", os.path.dirname(os.path.dirname(files[0]))).parquet(*files)
    assert C.rows_of(written, "doc_id", "text", "more") == C.rows_of(df, "doc_id", "text", "more")
    assert C.rows_of(written, "doc_id", "shard", "slot") == C.rows_of(out, "doc_id", "shard", "slot")


def test_shuffle_is_repeatable_and_mixes(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    runs = [sharding.shard_documents(df.repartition(p), bucket_bytes=40_000).collect() for p in (3, 7)]
    places = [{r.doc_id: (r.shard, r.slot) for r in run} for run in runs]
    assert places[0] == places[1]
    order = [i for i, _ in sorted(places[0].items(), key=lambda kv: kv[1])]
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.06


def test_copies_of_one_record_spread_over_buckets(spark):
    df = spark.range(3000).selectExpr("cast(1 as long) as doc_id", "'same' as text")
    out = sharding.shard_documents(df, bucket_bytes=20_000)
    assert out.groupBy("shard").count().collect() and out.count() == 3000


def test_write_shards_keeps_whole_records(docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert C.rows_of(back, "doc_id", "text") == C.rows_of(docs, "doc_id", "text")


# --- 9: packing

def test_plan_places_every_piece_and_fills_exactly():
    pick = np.random.default_rng(6)
    for _ in range(20):
        lengths = np.concatenate([pick.integers(1, 65, 200), np.full(7, 64)])
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        entries = packing.plan(counts, 64)
        used: dict = {}
        for parts, times in entries:
            assert sum(parts) <= 64
            for p in parts:
                used[p] = used.get(p, 0) + times
        assert used == counts
        assert len(entries) <= 2 * 64
        bins: list[int] = []  # best fit decreasing, piece by piece
        for x in sorted(lengths.tolist(), reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= x), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(64 - x)
            else:
                bins[fit] -= x
        assert -(-int(lengths.sum()) // 64) <= sum(t for _, t in entries) <= len(bins) + 2


def test_plan_of_many_short_pieces_wastes_nothing():
    pick = np.random.default_rng(8)
    lengths = np.minimum(4096, np.exp(pick.normal(6, 1.2, 5000)).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert sum(t for _, t in packing.plan(counts)) == -(-int(lengths.sum()) // 4096)


def test_packing_equals_the_library_and_fits(docs, library):
    import zlib

    out = packing.pack_documents(docs).collect()
    want = []
    for i, text in ROWS:
        ids = np.array([*library_ids(library, text), 1], "<u4")
        want += [(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096]))
                 for k, a in enumerate(range(0, len(ids), 4096))]
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr)
    assert got == sorted(want, key=repr)
    held: dict = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(held) <= -(-sum(w[3] for w in want) // 4096) + 1


# --- empty tables

def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    for fn in (suffixdedup.remove_repeats, chunkcode.encode_decode, lm.ctw_scores, simhash.simhash_table,
               simhash.drop_near_copies, substrings.dedup_table, substrings.remove_repeats, sharding.shard_documents,
               packing.pack_documents, lambda d: quality.quality_table(d, quality.all_content())):
        out = fn(empty)
        assert out.collect() == [] and "doc_id" in out.columns


# --- hashes of words and lines

def thue_morse(n: int = 1024) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark, library):
    import hashlib

    t, u = thue_morse()
    rows = [(0, t), (1, u), (2, f"{t} {u}"), (3, f"{t}\n{u}\n{t[:512]}\n{u[:512]}"), (4, f"x {u} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in chunkcode.encode_decode(df).collect()}
    for i, text in rows:
        assert got[i].ids_sha256 == hashlib.sha256(np.array(library_ids(library, text), "<u4").tobytes()).hexdigest()
    encoder = tokens.Encoder(tokens.vocabulary_path())
    ids, first = encoder.of_texts(textkit.Texts([x.encode() for _, x in rows]))
    for i, (_, text) in enumerate(rows):
        assert ids[first[i]:first[i + 1]].tolist() == library_ids(library, text)
    scored = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in lm.ctw_scores(df).collect())
    assert scored == [w[:5] for w in sorted(C.base_scores(rows))]
    base, _ = quality.measure(textkit.Texts([x.encode() for _, x in rows]))
    assert base["n_dup_lines"].tolist() == [C.quality(x)[3] for _, x in rows] == [0] * 5


def test_span_hash_tells_spans_apart():
    pick = np.random.default_rng(4)
    data = pick.integers(0, 3, 40000).astype(np.uint8)
    starts = pick.integers(0, 39000, 20000)
    ends = starts + pick.choice([0, 1, 2, 7, 8, 9, 16, 17, 600, 700], 20000)
    codes = textkit.span_hash(data, starts, ends)
    spans = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert len(set(spans)) == len(set(codes.tolist())) == len(set(zip(spans, codes.tolist())))
