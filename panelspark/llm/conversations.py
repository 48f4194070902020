"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(system? (user assistant)+)?``.

Rows of a conversation are taken by (turn, role, text), nulls first.  Edits: Keep (0), Rerole to user or assistant (2), Delete
(3; blank rows and repeats of an earlier role and text must go), Insert an empty user or assistant turn (2); a truncated row that
is not deleted adds 1.  Among the cheapest ways the one whose string of edit initials is least in ASCII order is taken.

Method: Hirschberg's divide and conquer over four states (nothing yet; after the system, the user, the assistant).  Forward
costs of the first half and backward costs of the second meet mid-conversation; among the cheapest crossings the one with the least
audit is taken, and both halves are solved alone, so only four costs and four ranks are held beside the rows and the
answer.  Ranks order the least audits that lead to each state: audits of equally many rows never are prefixes of one another (an
insertion stands before a row, or after the last), so an earlier difference decides and no audit need be kept to compare.

Distribution: equal rows are counted first, then rows are dealt over ranges of (conversation, turn, role, text) and each range is
cut into chunks of one conversation, ``CHUNK_BYTES`` of text at most.  A conversation that lies in one chunk inside a range is solved
there.  The others, of any length, are solved as one tree: each chunk gives its 4 × 4 costs and ranks, these are composed for each
range and then for each conversation, crossings are handed down to ranges and to chunks, and each chunk is solved between its two
states.  A repeat across chunks is found by digests of role and text.  No task holds more of a conversation than a chunk's texts;
only its report, one row by contract, streams over the conversation's chunks, because SHA-256 reads in order.

Defined cases: null conv_ids are one conversation; a null role or text is one space; null turns come first and count for no gap;
equal rows count as often as they stand; a row of 0 copies is not there, but its conversation is reported, with zeros if nothing
else is left of it; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import blobs
from panelspark.llm.common import materialise, partitions, small_batches

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
#: Conversations of up to so many symbols are remembered by a worker.
SHORT = 40

NONE = 1 << 60
REROLE, DELETE, INSERT = 2, 3, 2
_SPACE = " \t\n\x0b\x0c\r"
#: The state that an inserted or reroled turn leads to, from each state, and its role.
NEXT = (2, 2, 3, 2)
ROLE = (None, "system", "user", "assistant")
_INITIAL = {"s": 1, "u": 2, "a": 3}
_KEEP = {1: (0,), 2: (0, 1, 3), 3: (2,)}  # states from which a kept turn may lead to the state of its initial
#: Insertions after the last row that lead to an end.
TAIL = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}


def _moves(symbol: int) -> list[list[tuple[int, int, str]]]:
    """For each state: from where, at what cost and with which letters a row leads there.  A row is deleted without insertions
    before it: they could as well stand after it, for a lesser audit."""
    kind, truncated = symbol >> 1, symbol & 1
    into: list[list[tuple[int, int, str]]] = [[(p, DELETE, "D")] for p in range(4)]
    for p in range(4):
        at = p
        for inserted in range(3):
            cost, letters = INSERT * inserted + truncated, "I" * inserted
            into[NEXT[at]].append((p, cost + REROLE, letters + "R"))
            if kind and at in _KEEP[kind]:
                into[kind].append((p, cost, letters + "K"))
            at = NEXT[at]
    return into


MOVES = [_moves(s) for s in range(8)]
OUT = [[[(q, c) for q in range(4) for f, c, _ in MOVES[s][q] if f == p] for p in range(4)] for s in range(8)]

Vector = tuple[list[int], list[int]]  # costs of the four states, and the ranks of their least audits


def _ranked(best: list[tuple]) -> Vector:
    """Costs and ranks from (cost, rank before, letters or rank after) of each state."""
    order = sorted(range(4), key=lambda q: best[q][1:])
    rank = [0] * 4
    for place, q in enumerate(order):
        rank[q] = place
    return [min(b[0], NONE) for b in best], rank


def start(state: int) -> Vector:
    return [0 if q == state else NONE for q in range(4)], [0] * 4


def forward(symbols, lo: int, hi: int, vector: Vector) -> Vector:
    """Over the rows lo to hi; a negative symbol is so many rows that must go."""
    cost, rank = vector
    for symbol in symbols[lo:hi]:
        if symbol < 0:
            cost = [c if c >= NONE else c - DELETE * symbol for c in cost]
            continue
        cost, rank = _ranked([min((cost[p] + c, rank[p], letters) for p, c, letters in into) for into in MOVES[symbol]])
    return cost, rank


def backward(symbols, lo: int, hi: int, state: int) -> list[int]:
    """Least costs from each state over the rows lo to hi to a state."""
    cost = start(state)[0]
    for symbol in reversed(symbols[lo:hi]):
        if symbol < 0:
            cost = [c if c >= NONE else c - DELETE * symbol for c in cost]
        else:
            cost = [min(min(cost[q] + c for q, c in out), NONE) for out in OUT[symbol]]
    return cost


def audit(symbols, begin: int, end: int, lo: int = 0, hi: int | None = None) -> str:
    """The least of the cheapest audits from a state to a state."""
    hi = len(symbols) if hi is None else hi
    if hi - lo == 0:
        return ""
    if hi - lo == 1:
        symbol = symbols[lo]
        return "D" * -symbol if symbol < 0 else min((c, letters) for p, c, letters in MOVES[symbol][end] if p == begin)[1]
    middle = (lo + hi) // 2
    cost, rank = forward(symbols, lo, middle, start(begin))
    rest = backward(symbols, middle, hi, end)
    cross = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
    return audit(symbols, begin, cross, lo, middle) + audit(symbols, cross, end, middle, hi)


def last_state(vector: Vector) -> int:
    cost, rank = vector
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(TAIL[s]), rank[s]))


def solve(symbols) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    vector = forward(symbols, 0, len(symbols), start(0))
    end = last_state(vector)
    return vector[0][end] + INSERT * len(TAIL[end]), audit(symbols, 0, end) + TAIL[end]


@lru_cache(1 << 15)
def _solve_short(symbols: tuple[int, ...]) -> tuple[int, str]:
    return solve(symbols)


# --- costs and ranks of chunks, 4 × 4, as one list: 16 costs and 16 ranks by (from, to)


def summary(symbols) -> list[int]:
    rows = [forward(symbols, 0, len(symbols), start(p)) for p in range(4)]
    return [c for cost, _ in rows for c in cost] + [r for _, rank in rows for r in rank]


def apply(vector: Vector, m) -> Vector:
    cost, rank = vector
    return _ranked([min((cost[s] + m[4 * s + q], rank[s], m[16 + 4 * s + q]) for s in range(4)) for q in range(4)])


def compose(chunks: list) -> list[int]:
    rows = []
    for p in range(4):
        vector = start(p)
        for m in chunks:
            vector = apply(vector, m)
        rows.append(vector)
    return [c for cost, _ in rows for c in cost] + [r for _, rank in rows for r in rank]


def crossings(chunks: list, begin: int, end: int | None) -> list[int]:
    """The states before the first chunk, between chunks, and after the last; no end: the best one."""
    vectors = [start(begin)]
    for m in chunks:
        vectors.append(apply(vectors[-1], m))
    state = last_state(vectors[-1]) if end is None else end
    out = [state]
    for vector, m in zip(reversed(vectors[:-1]), reversed(chunks)):
        cost, rank = vector
        state = min(range(4), key=lambda s: (cost[s] + m[4 * s + state], rank[s]))
        out.append(state)
    return out[::-1]


# --- rows

def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _blank(text: str) -> bool:
    return not text.strip(_SPACE)


def inspect(rows: list, earlier: Iterable[bytes] = ()) -> tuple[list[int], dict]:
    """The rows' symbols, and what the report says of them (``own``: the rows that have a symbol of their own).  ``earlier``:
    digests of roles and texts of earlier chunks."""
    earlier, seen = set(earlier), set()
    symbols: list[int] = []
    own: list[int] = []
    facts = {"n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None,
             "first_initial": None, "last_initial": None}

    def gone(times: int) -> None:
        if times and symbols and symbols[-1] < 0:
            symbols[-1] -= times
        elif times:
            symbols.append(-times)

    for place, (turn, role, text, copies) in enumerate(rows):
        if not copies:
            continue
        initial, before = role[:1], facts["last_initial"]
        facts["n_rows"] += copies
        facts["illegal"] += copies - 1 + (before is not None and before + initial not in LEGAL)
        if before is None:
            facts["first_initial"] = initial
        facts["last_initial"] = initial
        if turn is not None:
            facts["turns"] += turn != facts["high"]
            facts["low"] = turn if facts["low"] is None else facts["low"]
            facts["high"] = turn
        if _blank(text):
            facts["blank"] += copies
            gone(copies)
        elif (role, text) in seen or earlier and digest(role, text) in earlier:
            facts["duplicate"] += copies
            gone(copies)
        else:
            seen.add((role, text))
            truncated = text.rstrip(_SPACE)[-1] not in ".!?"
            facts["truncated"] += truncated
            facts["duplicate"] += copies - 1
            symbols.append(_INITIAL.get(initial, 0) << 1 | truncated)
            own.append(place)
            gone(copies - 1)
    return symbols, facts | {"own": own}


def edit(rows: list, symbols: list[int], own: list[int], letters: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, from a state on."""
    out: list[tuple[str, str, str]] = []
    at, place = 0, iter(own)

    def insert() -> None:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state = NEXT[state]
            out.append(("I", ROLE[state], ""))
            at += 1

    for symbol in symbols:
        if symbol < 0:
            at -= symbol
            continue
        _, role, text, _ = rows[next(place)]
        insert()
        if letters[at] == "K":
            state = _INITIAL[role[:1]]
            out.append(("K", role, text))
        elif letters[at] == "R":
            state = NEXT[state]
            out.append(("R", ROLE[state], text))
        at += 1
    insert()
    return out


# --- Spark

_FACTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_initial", "last_initial")
_FACT_TYPES = ("n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
               "first_initial string, last_initial string")


def pack_rows(rows: list) -> bytes:
    return blobs.pack_bytes(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode(), 1)


def unpack_rows(blob: bytes) -> list:
    return json.loads(blobs.unpack_bytes(blob))


def _batch(names: list[str], rows: list[tuple], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _cutter(chunk_bytes: int, chunk_rows: int):
    """Cut the sorted rows of a range into chunks (part, seg, no, open, conv_id, blob); open: its conversation may lie in more
    than one."""
    names = ["part", "seg", "no", "open", "conv_id", "blob"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ready: list[tuple] = []  # chunks to send
        last: tuple | None = None  # a conversation of one chunk, until another follows it
        rows: list = []
        here, seg, no, first_no, size, kind = None, -1, 0, 0, 0, pa.null()

        def chunk(of: int, is_open: bool) -> tuple:
            nonlocal rows, size, no
            made = (part, of, no, is_open, here, pack_rows(rows))
            rows, size, no = [], 0, no + 1
            return made

        def close() -> None:
            """The conversation ends here."""
            nonlocal last
            if last is not None:
                ready.append(last)
                last = None
            if no > first_no:
                ready.append(chunk(seg, True))
            else:
                last = chunk(seg, seg == 0)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]
            for conv, *row in zip(*columns):
                if seg < 0 or conv != here:
                    if seg >= 0:
                        close()
                    here, seg, first_no = conv, seg + 1, no
                elif size >= chunk_bytes or len(rows) >= chunk_rows:
                    ready.append(chunk(seg, True))
                rows.append(row)
                size += len(row[2] or "") + 16
            if ready:
                yield _batch(names, ready, [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), kind, pa.binary()])
                ready = []
        if seg >= 0:
            close()
            if last is not None:
                ready.append((*last[:3], True, *last[4:]))
            yield _batch(names, ready, [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), kind, pa.binary()])

    return cut


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the roles and texts of each chunk."""
    for batch in batches:
        for i, blob in enumerate(batch.column("blob").to_pylist()):
            found = {digest(role, text) for _, role, text, copies in unpack_rows(blob) if copies and not _blank(text)}
            if found:
                take = batch.select(["conv_id", "part", "no"]).take(pa.array([i] * len(found)))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(sorted(found), pa.binary())],
                                                 ["conv_id", "part", "no", "digest"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [summary(inspect(unpack_rows(b), e or ())[0])
                 for b, e in zip(batch.column("blob").to_pylist(), batch.column("earlier").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("part", "seg", "no", "conv_id")), pa.array(found, pa.list_(pa.int64()))],
            ["part", "seg", "no", "conv_id", "costs"])


def _composed(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        return pd.DataFrame({"part": pdf["part"][:1], "seg": pdf["seg"][:1], "conv_id": pdf["conv_id"][:1],
                             "costs": [compose(list(pdf["costs"]))]})

    return run, f"part int, seg int, conv_id {kind}, costs array<long>"


def _placed(key: str):
    """Hand the crossings of a group down to its members, in the order of ``key``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        begin, end, final = (int(pdf[c].iloc[0]) for c in ("from_state", "to_state", "final"))
        states = crossings(list(pdf["costs"]), begin, None if end < 0 else end)
        last = [False] * (len(pdf) - 1) + [bool(final)]
        return pd.DataFrame({"part": pdf["part"], key: pdf[key], "from_state": states[:-1], "to_state": states[1:],
                             "final": [int(x) for x in last]}) if key != "part" else pd.DataFrame(
            {"part": pdf["part"], "seg": pdf["seg"], "from_state": states[:-1], "to_state": states[1:],
             "final": [int(x) for x in last]})

    name = "seg" if key == "part" else key
    return run, f"part int, {name} int, from_state int, to_state int, final int"


def _solver(whole: bool):
    """Solve chunks: conversations of one chunk, or chunks between two given states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in ("earlier", "from_state", "to_state", "final")] if not whole else []
            audits, costs, turns, facts = [], [], [], []
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                rows = unpack_rows(blob)
                earlier, begin, end, final = [g[i] for g in given] if given else ((), 0, None, True)
                symbols, seen = inspect(rows, earlier or ())
                own = seen.pop("own")
                if whole:
                    cost, letters = _solve_short(tuple(symbols)) if len(symbols) <= SHORT else solve(symbols)
                else:
                    letters = audit(symbols, begin, end)
                    cost = forward(symbols, 0, len(symbols), start(begin))[0][end]
                    if final:
                        letters, cost = letters + TAIL[end], cost + INSERT * len(TAIL[end])
                audits.append(letters)
                costs.append(cost)
                facts.append(seen)
                turns.append(pack_rows(edit(rows, symbols, own, letters, begin)))
            types = [pa.int64()] * 8 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "part", "no")), pa.array([whole] * len(costs), pa.bool_()),
                 *(pa.array([f[n] for f in facts], t) for n, t in zip(_FACTS, types)), pa.array(costs, pa.int64()),
                 pa.array(audits, pa.string()), pa.array(turns, pa.binary())],
                ["conv_id", "part", "no", "whole", *_FACTS, "cost", "audit", "repaired"])

    return run


def repair(conversations: DataFrame, copies: str | None = None, chunk_bytes: int = CHUNK_BYTES,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Repaired conversations in chunks: (conv_id, part, no, whole, facts of the rows, cost, audit, repaired).  A conversation's
    chunks follow one another by (part, no); ``whole``: it has this one only.  ``repaired`` holds the turns, packed (see ``turns``).

    ``copies``: a column that says how often a row stands (0: not at all).
    """
    spark = small_batches(conversations.sparkSession)
    times = F.coalesce(F.col(copies).cast("long"), F.lit(1)) if copies else F.lit(1).cast("long")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), times.alias("copies"))
    there = F.col("copies") > 0  # one row without a role stands for all that are not there
    rows = rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ranged = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "role", F.substring("text", 1, 64))
    ranged = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    # written once: a range's bounds are a sample's, and what follows reads the chunks several times
    chunks = materialise(ranged.mapInArrow(_cutter(chunk_bytes, chunk_rows),
                                           f"part int, seg int, no int, open boolean, conv_id {kind}, blob binary"))
    out = f"conv_id {kind}, part int, no int, whole boolean, {_FACT_TYPES}, cost long, audit string, repaired binary"
    closed = chunks.where(~F.col("open")).mapInArrow(_solver(True), out)

    split = chunks.where("open")
    firsts = split.mapInArrow(_firsts, f"conv_id {kind}, part int, no int, digest binary")
    order = Window.partitionBy("conv_id", "digest").orderBy("part", "no")
    earlier = (firsts.withColumn("place", F.row_number().over(order)).where("place > 1")
               .groupBy("part", "no").agg(F.collect_list("digest").alias("earlier")))  # a chunk's own rows bound it
    split = split.join(earlier, ["part", "no"], "left")
    costs = materialise(split.mapInArrow(_summaries, f"part int, seg int, no int, conv_id {kind}, costs array<long>"))
    ranges = costs.groupBy("part", "seg").applyInPandas(*_composed(kind))
    ends = {"from_state": F.lit(0), "to_state": F.lit(-1), "final": F.lit(1)}
    of_ranges = ranges.withColumns(ends).groupBy("conv_id").applyInPandas(*_placed("part"))
    of_chunks = costs.join(of_ranges, ["part", "seg"]).groupBy("part", "seg").applyInPandas(*_placed("no"))
    opened = split.join(of_chunks, ["part", "no"]).mapInArrow(_solver(False), out)
    return closed.unionByName(opened)


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, no, at, edit, role, text): the turns that repair leaves, in the order of (part, no, at)."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column("repaired").to_pylist()):
                rows = unpack_rows(blob)
                if rows:
                    take = batch.select(["conv_id", "part", "no"]).take(pa.array([i] * len(rows)))
                    edits, roles, texts = (pa.array(list(c), pa.string()) for c in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [*take.columns, pa.array(range(len(rows)), pa.int32()), edits, roles, texts],
                        ["conv_id", "part", "no", "at", "edit", "role", "text"])

    return repaired.select("conv_id", "part", "no", "repaired").mapInArrow(
        run, f"conv_id {kind}, part int, no int, at int, edit string, role string, text string")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Report:
    """One conversation's report, from its chunks in order."""

    def __init__(self):
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.begun = False

    def add(self, chunk: dict) -> None:
        for name in self.sums:
            self.sums[name] += chunk[name]
        if chunk["low"] is not None:
            self.sums["turns"] -= chunk["low"] == self.high
            self.low = chunk["low"] if self.low is None else self.low
            self.high = chunk["high"]
        if chunk["n_rows"]:
            if self.initial is not None:
                self.sums["illegal"] += self.initial + chunk["first_initial"] not in LEGAL
            self.initial = chunk["last_initial"]
        self.audit.append(chunk["audit"])
        found = unpack_rows(chunk["repaired"])
        if found:
            text = "\n".join(f"{role}:{text}" for _, role, text in found)
            self.hash.update((("\n" if self.begun else "") + text).encode())
            self.begun = True

    def row(self) -> tuple:
        s = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - s["turns"]
        return (gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(self.audit),
                self.hash.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one conversation after another, in order."""
    here, report = None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for chunk in batch.to_pylist():
            if report is None or chunk["whole"] or chunk["conv_id"] != here:
                if report is not None:
                    done.append((here, *report.row()))
                here, report = chunk["conv_id"], _Report()
            report.add(chunk)
        yield _batch(["conv_id", *REPORT], done, [kind] + [pa.int64()] * 6 + [pa.string()] * 2)
    if report is not None:
        yield _batch(["conv_id", *REPORT], [(here, *report.row())], [kind] + [pa.int64()] * 6 + [pa.string()] * 2)


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit and the repaired text's SHA-256."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    out = (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
    parts = repaired.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return repaired.where("whole").mapInArrow(_reports, out).unionByName(parts.mapInArrow(_reports, out))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults of the query: by CRC-32 of ``conv_id:turn`` modulo 20, 0 drops a row (``copies`` 0), 1 empties its
    text, 2 takes its ``. ! ?``, 3 repeats it, 4 makes it the user's."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return report(repair(damaged(conversations), "copies"))
