"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Every line that holds a word is a step of the chain; its observations are shares and counts of the line itself
(``FEATURES``).  Viterbi decoding gives the best labelling of a whole text, and the text is kept if the content lines
hold at least ``min_content`` of its word characters.  ``base_failed`` texts (under ``MIN_WORDS`` words, or more than
``MAX_REPEAT_PERCENT`` of the words in repeated 8-word windows) are never kept.

The field is fitted by maximum likelihood (forward-backward, Adam) on a bounded sample of labelled documents: at most
``sample`` of them, those with the smallest hash of their id.  The lines of a good document are content; those of a bad one are boilerplate
if they look so on their own (a first fit with each line as a chain), as a bad text also holds ordinary lines.  Only
their features reach the driver: for each document at most ``fit_lines`` lines, a run from any place in it.  Scoring uses every line.

Defined cases: a null or empty text has no words, so it fails the base rule; null ids are scored like others and stay
null; repeated rows are scored each; an empty table gives an empty result; without labels of both kinds the field
marks everything content, so the base rule alone decides.  Other columns of the input are passed over by
``quality_table`` and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textkit as K
from panelspark.llm.common import small_batches

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SAMPLE = 4000
MIN_CONTENT = 0.5
#: Lines of a labelled document that the fit reads: a run that begins anywhere in it.
FIT_LINES = 32

FEATURES = ("symbol_share", "bar_share", "mark_share", "upper_share", "digit_share", "stop_share", "mean_word_chars",
            "log_words", "repeated_line", "repeat_share", "bias")
_SYMBOL, _BAR, _MARK, _STOP, _DIGIT, _UPPER = (
    K.class_table(x) for x in (b"#*$%&|<>", b"|", b"!", b".,;:?", b"0123456789", bytes(range(65, 91))))


class Field(NamedTuple):
    """Weights of the label boilerplate against content, its start, and the transitions [from, to]."""

    weights: np.ndarray
    start: float
    move: np.ndarray


class Lines(NamedTuple):
    text: np.ndarray  # index of the text of each line
    chars: np.ndarray  # code points in its words
    features: np.ndarray


def measure(texts: K.Texts) -> tuple[dict[str, np.ndarray], Lines]:
    """The base figures of each text, and its lines that hold a word."""
    data = texts.data
    starts, ends, first = texts.words()
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    sums = {}
    for name, flags in (("chars", ((data & 0xC0) != 0x80) & ~K.SPACE[data]), ("symbol", _SYMBOL[data]),
                        ("bar", _BAR[data]), ("mark", _MARK[data]), ("upper", _UPPER[data]), ("digit", _DIGIT[data]),
                        ("stop", _STOP[data])):
        sums[name] = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[name][1:])
    of_text = {k: (v[texts.ends] - v[texts.starts]).astype(np.int64) for k, v in sums.items()}
    word_codes = K.span_hash(data, starts, ends)

    # windows of eight words inside one text, keyed by text and content
    salt = K.mix64(np.arange(len(texts), dtype=np.uint64))
    windows = K.RangeHash(word_codes, "word").windows(WINDOW)
    whole = owner[:len(windows)] == owner[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    twice = np.zeros(len(windows), bool)
    twice[whole] = K.repeated(windows[whole] ^ salt[owner[:len(windows)][whole]])
    edge = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)]) if len(starts) else np.zeros(1, np.int64)

    # lines with a word
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1])
    word_from, word_to = np.searchsorted(starts, begin), np.searchsorted(starts, breaks)
    full = word_to > word_from
    begin, breaks, word_from, word_to = begin[full], breaks[full], word_from[full], word_to[full]
    of_line = np.searchsorted(texts.starts, begin, side="right") - 1
    keys = K.span_hash(data, begin, breaks) ^ salt[of_line]
    _, earliest = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[earliest] = False

    base = {"n_words": n_words.astype(np.int64), "word_chars": of_text["chars"], "n_symbols": of_text["symbol"],
            "n_dup_lines": np.bincount(of_line[again], minlength=len(texts)).astype(np.int64),
            "n_repeat_words": covered[first[1:]] - covered[first[:-1]]}
    line = {k: v[breaks] - v[begin] for k, v in sums.items()}
    chars, words = np.maximum(line["chars"], 1), word_to - word_from
    features = np.stack([*(line[k] / chars for k in ("symbol", "bar", "mark", "upper", "digit", "stop")),
                         np.minimum(chars / words, 30) / 10, np.log1p(words) / 3, again,
                         (covered[word_to] - covered[word_from]) / words, np.ones(len(words))], axis=1) \
        if len(words) else np.zeros((0, len(FEATURES)))
    return base, Lines(of_line, line["chars"], features)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def _chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of lines of one text."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(owner)))


def viterbi(field: Field, owner: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The most likely labels (1: boilerplate) of all chains at once: one numpy step for each position in a chain."""
    labels = np.zeros(len(owner), np.int8)
    at, length = _chains(owner)
    if not len(at):
        return labels
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    score = features @ field.weights
    back = np.zeros((len(owner), 2), np.int8)
    best = np.zeros((len(at), 2))
    best[:, 1] = field.start + score[at]
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t))  # chains longer than t
        ways = best[:n, :, None] + field.move[None]
        back[at[:n] + t] = ways.argmax(axis=1)
        best[:n] = ways.max(axis=1)
        best[:n, 1] += score[at[:n] + t]
    state = best.argmax(axis=1).astype(np.int8)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t))
        labels[at[:n] + t] = state[:n]
        if t:
            state[:n] = back[at[:n] + t, state[:n]]
    return labels


def train(owner: np.ndarray, features: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.1,
          ridge: float = 1e-3) -> Field:
    """Maximum likelihood of labelled chains by Adam; the gradient is from the forward-backward recursions."""
    at, length = _chains(owner)
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    deep, k = int(length[0]), features.shape[1]
    scale = np.maximum(np.sqrt((features ** 2).mean(axis=0)), 1e-6)
    features = features / scale
    index = np.minimum(at[:, None] + np.arange(deep), len(owner) - 1)
    alive = np.arange(deep) < length[:, None]
    pairs = alive[:, 1:]
    gold = labels[index]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    seen_weights, seen_start = features.T @ labels, gold[:, 0].sum()
    theta = np.zeros(k + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, start, move = theta[:k], theta[k], theta[k + 1:].reshape(2, 2)
        emit = np.zeros((len(at), deep, 2))
        emit[..., 1] = (features @ weights)[index]
        ahead = np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        ahead[:, 0, 1] += start
        for t in range(1, deep):
            ahead[:, t] = emit[:, t] + np.logaddexp(ahead[:, t - 1, :1] + move[0], ahead[:, t - 1, 1:] + move[1])
        behind = np.zeros_like(emit)
        for t in range(deep - 2, -1, -1):
            later = emit[:, t + 1] + behind[:, t + 1]
            way = np.logaddexp(later[:, :1] + move[None, :, 0], later[:, 1:] + move[None, :, 1])
            behind[:, t] = np.where(alive[:, t + 1, None], way, 0)
        total = np.logaddexp(*np.moveaxis(ahead[np.arange(len(at)), length - 1], -1, 0))
        mark = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]) * alive
        both = np.exp(ahead[:, :-1, :, None] + move + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
        flat = np.zeros(len(owner))
        np.add.at(flat, index[alive], mark[alive])
        slope = np.concatenate([seen_weights - features.T @ flat, [seen_start - mark[:, 0].sum()],
                                (seen_moves - (both * pairs[..., None, None]).sum(axis=(0, 1))).ravel()])
        slope = slope / len(at) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Field(theta[:k] / scale, float(theta[k]), theta[k + 1:].reshape(2, 2))


def all_content() -> Field:
    weights = np.zeros(len(FEATURES))
    weights[-1] = -1.0
    return Field(weights, 0.0, np.zeros((2, 2)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_lines: int = FIT_LINES) -> Field:
    """Fit on at most ``sample`` labelled documents (``quality`` 0 or 1), one text for each doc_id (the least, if there are
    several), and on at most ``fit_lines`` consecutive lines of each, whose place in the text a hash of the text draws."""
    small_batches(docs.sparkSession)
    # both kinds in their natural proportion; the sample holds ``sample`` ids at most
    picked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .select("doc_id", "quality").distinct()
              .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "quality").limit(sample))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches):
            _, found = measure(K.Texts(K.as_bytes(batch.column("text"))))
            at, length = _chains(found.text)
            rank = np.arange(len(found.text)) - np.repeat(at, length)
            texts = K.as_bytes(batch.column("text"))
            draw = np.array([xxhash.xxh3_64_intdigest(texts[i], 5) for i in found.text[at].tolist()], np.uint64)
            first = (draw % np.maximum(length - fit_lines + 1, 1).astype(np.uint64)).astype(np.int64)
            rank = rank - np.repeat(first, length)
            use = (rank >= 0) & (rank < fit_lines)
            owner = batch.column("doc_id").take(pa.array(found.text[use]))
            label = batch.column("quality").take(pa.array(found.text[use]))
            yield pa.RecordBatch.from_arrays(
                [owner.cast(pa.string()), pa.array(rank[use], pa.int32()), label.cast(pa.int32()),
                 pa.array(list(found.features[use]), pa.list_(pa.float64()))], ["doc", "rank", "label", "features"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
            .mapInArrow(lines, "doc string, rank int, label int, features array<double>").toPandas())
    if rows["label"].nunique() < 2:
        return all_content()
    rows = rows.sort_values(["doc", "rank"], kind="stable")
    rows = rows.drop_duplicates(["doc", "rank"])
    boilerplate = 1 - rows["label"].to_numpy()
    features = np.array(rows["features"].tolist())
    alone = train(np.arange(len(rows)), features, boilerplate)
    looks = features @ alone.weights + alone.start > 0
    return train(rows["doc"].to_numpy(), features, boilerplate * looks)


def judge(texts: K.Texts, field: Field, min_content: float) -> dict[str, np.ndarray]:
    base, lines = measure(texts)
    content = viterbi(field, lines.text, lines.features) == 0
    held = np.bincount(lines.text[content], lines.chars[content], minlength=len(texts))
    share = held / np.maximum(base["word_chars"], 1)
    failed = base_failed(base)
    return base | {"base_failed": failed, "kept": ~failed & (share >= min_content), "content_share": share,
                   "n_lines": np.bincount(lines.text, minlength=len(texts)).astype(np.int64),
                   "n_content_lines": np.bincount(lines.text[content], minlength=len(texts)).astype(np.int64)}


OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "kept boolean, content_share double, n_lines long, n_content_lines long")


def quality_table(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per document: its id, the base figures, the verdict and the content share."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches):
            found = judge(K.Texts(K.as_bytes(batch.column("text"))), field, min_content)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())],
                                             ["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {OUT}")


def keep_good(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.document_groups(batches):
            yield batch.filter(pa.array(judge(K.Texts(K.as_bytes(batch.column("text"))), field, min_content)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
