"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, lengths and repetition, of
the line and of its two neighbours. Forward-backward gives the marginal of each line, and the marginals,
weighted by line length, make the quality of the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import held_out, per_step, texts

#: The fit learns from this many labelled documents at most, and only from such with this many lines at most.
SAMPLE, SAMPLE_LINES = 2000, 300
THRESHOLD = 0.3
GOOD, BAD = 1, 0
KINDS = ("lower", "upper", "digit", "space", "stop", "shout", "bar", "symbol", "lead", "rest")
OWN = len(KINDS) + 6


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("symbol"), np.int64)
    table[97:123], table[65:91], table[48:58] = (KINDS.index(k) for k in ("lower", "upper", "digit"))
    table[0x80:0xC0], table[0xC0:] = KINDS.index("rest"), KINDS.index("lead")
    for kind, signs in (("space", b" \t\r\x0b\x0c"), ("stop", b".,;:'\"-()"), ("shout", b"!?"), ("bar", b"|")):
        table[list(signs)] = KINDS.index(kind)
    return table


KIND = _kinds()


@dataclass
class Lines:
    """Lines of several documents, one after another: own features, lengths in bytes, first line of each document."""

    own: np.ndarray
    size: np.ndarray
    first: np.ndarray

    @property
    def features(self) -> np.ndarray:
        """Of a line, the line before and the line after, with marks where there is none."""
        n = len(self.own)
        starts = np.zeros(n + 1, bool)
        starts[self.first] = True
        starts[n] = True
        out = np.zeros((n, 3 * OWN + 3), np.float32)
        out[:, :OWN] = self.own
        out[1:, OWN:2 * OWN] = self.own[:-1] * ~starts[1:n, None]
        out[:-1, 2 * OWN:3 * OWN] = self.own[1:] * ~starts[1:n, None]
        out[:, -3], out[:, -2], out[:, -1] = starts[:n], starts[1:], 1.0
        return out


def lines_of(values: list[bytes]) -> Lines:
    """Cuts whole texts at line feeds; an empty text is one empty line."""
    data = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins
    text_begin = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])[:-1]]).astype(np.int64)
    first = np.searchsorted(begins, text_begin)
    n = len(begins)
    line = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(line * len(KINDS) + KIND[data], minlength=n * len(KINDS)).reshape(n, len(KINDS)).astype(np.float32)
    counts[:, KINDS.index("symbol")] -= 1  # the line feed itself
    whole = np.maximum(sizes, 1)[:, None]
    raw, seen = data.tobytes(), set()
    #: The line was in the document before; words equal to the word before; words that the line has already.
    repeated, stuck, again = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
    marks = set(first.tolist())
    for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        if i in marks:
            seen = set()
        if b > a:
            text = raw[a:b]
            repeated[i] = text in seen
            seen.add(text)
            own = text.split()
            if len(own) > 1:
                stuck[i] = sum(map(eq, own, own[1:])) / len(own)
                again[i] = 1 - len(set(own)) / len(own)
    words = counts[:, KINDS.index("space")] + 1
    extra = np.stack([np.log1p(sizes) / 8, np.minimum(sizes / words, 30) / 10, repeated, sizes == 0, stuck, again], 1)
    return Lines(np.hstack([np.sqrt(counts / whole), extra]).astype(np.float32), sizes, first)


class Chains:
    """Lines of all documents by position: step t holds the t-th line of every document that has one."""

    def __init__(self, first: np.ndarray, n: int) -> None:
        lengths = np.diff(np.append(first, n))
        self.order = np.argsort(-lengths, kind="stable")
        starts, lengths = first[self.order], lengths[self.order]
        self.steps = [starts[: int(np.searchsorted(-lengths, -t, "left"))] + t for t in range(int(lengths.max(initial=0)))]
        self.n, self.lengths = n, lengths

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of the lines, expected transitions and the log of the partition functions."""
        forward, backward = np.empty((self.n, 2)), np.zeros((self.n, 2))
        add = lambda x, axis: np.logaddexp(x.take(0, axis), x.take(1, axis))
        for t, at in enumerate(self.steps):
            forward[at] = unary[at] + (add(forward[self.steps[t - 1][: len(at)], :, None] + pair, 1) if t else 0.0)
        expected = np.zeros((2, 2))
        total = 0.0
        for t in range(len(self.steps) - 1, -1, -1):
            at = self.steps[t]
            after = len(self.steps[t + 1]) if t + 1 < len(self.steps) else 0
            if len(at) > after:  # last lines
                total += float(np.logaddexp(forward[at[after:], 0], forward[at[after:], 1]).sum())
            if after:
                nxt = self.steps[t + 1]
                coming = unary[nxt] + backward[nxt]
                backward[at[:after]] = add(pair[None] + coming[:, None, :], 2)
                joint = forward[at[:after], :, None] + pair[None] + coming[:, None, :]
                joint = np.exp(joint - joint.max((1, 2), keepdims=True))
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        both = forward + backward
        good = 1.0 / (1.0 + np.exp(np.clip(both[:, BAD] - both[:, GOOD], -500, 500)))
        return good, expected, total


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 12) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        w -= np.linalg.solve(hessian, x.T @ (p - y) + l2 * w)
    return w


@dataclass
class QualityModel:
    unary: np.ndarray
    pair: np.ndarray
    scale: np.ndarray

    def line_marginals(self, lines: Lines) -> np.ndarray:
        score = np.zeros((len(lines.own), 2))
        score[:, GOOD] = lines.features @ self.unary
        return Chains(lines.first, len(score)).marginals(score, self.pair)[0]

    def shares(self, lines: Lines) -> np.ndarray:
        """Good share of each document: marginals weighted by line length."""
        weight = lines.size + 1.0
        good = self.line_marginals(lines)
        return np.add.reduceat(good * weight, lines.first) / np.add.reduceat(weight, lines.first)

    def scores(self, lines: Lines) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale[0] + self.scale[1] * self.shares(lines), -30, 30)))


def fit(lines: Lines, labels: np.ndarray, rounds: int = 80) -> QualityModel:
    """Lines of good documents are good. Of a bad document those lines are bad that a first classifier on
    the line alone holds for bad, or all where it finds none. The field is then fitted to these lines by
    its likelihood, and the good share of a document is scaled to the labels."""
    n = len(lines.own)
    text = np.repeat(np.arange(len(lines.first)), np.diff(np.append(lines.first, n)))
    bad_text = labels[text] == 0
    own = np.hstack([lines.own, np.ones((n, 1), np.float32)]).astype(np.float64)
    looks_bad = 1.0 / (1.0 + np.exp(-np.clip(own @ _logistic(own, bad_text.astype(float), 1.0), -30, 30))) > 0.5
    bad = bad_text & looks_bad
    none = np.bincount(text, bad, len(labels)) == 0
    bad |= bad_text & none[text]
    y = (~bad).astype(float)
    x = lines.features.astype(np.float64)
    chains = Chains(lines.first, n)
    inner = np.setdiff1d(np.arange(n), lines.first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
    unary, pair = _logistic(x, y, 1.0), np.zeros((2, 2))
    moment, spread = np.zeros(len(unary) + 4), np.zeros(len(unary) + 4)
    for k in range(1, rounds + 1):
        score = np.zeros((n, 2))
        score[:, GOOD] = x @ unary
        good, expected, _ = chains.marginals(score, pair)
        gradient = np.concatenate([x.T @ (y - good) - unary, (seen - expected - pair).ravel()]) / n
        moment, spread = 0.9 * moment + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        move = 0.05 * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        unary, pair = unary + move[:-4], pair + move[-4:].reshape(2, 2)
    model = QualityModel(unary.astype(np.float32), pair, np.zeros(2))
    share = model.shares(lines)
    model.scale = _logistic(np.stack([np.ones(len(share)), share], 1), labels.astype(float), 0.1, 25)
    return model


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[Lines, np.ndarray] | None:
    """Line features of at most `sample` labelled documents that are not held out, by a hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # A join from the labelled side: its size is bounded by `sample`.
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").limit(sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = lines_of(batch.column("text").cast(pa.binary()).to_pylist())
        ends = np.append(lines.first, len(lines.own))[1:]
        own = [lines.own[a:b].tobytes() for a, b in zip(lines.first, ends, strict=True)]
        size = [lines.size[a:b].astype(np.int64).tobytes() for a, b in zip(lines.first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(own, pa.binary()), pa.array(size, pa.binary())], ["doc_id", "quality", "own", "size"])

    rows = (docs.join(F.broadcast(chosen), "doc_id").filter(F.regexp_count("text", F.lit("\n")) < SAMPLE_LINES).select("doc_id", "text", "quality")
            .mapInArrow(per_step(measured), f"doc_id {kind}, quality int, own binary, size binary").collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["own"])))
    own = np.frombuffer(b"".join(bytes(r["own"]) for r in rows), np.float32).reshape(-1, OWN)
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in rows), np.int64)
    counts = np.array([len(r["size"]) // 8 for r in rows])
    return Lines(own, size, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)), np.array([r["quality"] for r in rows])


def _fitted(rows: DataFrame, labels: DataFrame, sample: int) -> tuple[QualityModel | None, float]:
    """The model, or none and the score that all texts get."""
    drawn = _sample(rows, labels.select("doc_id", "quality"), sample)
    if drawn is None:
        return None, 0.5
    share = float(drawn[1].mean())
    return (fit(*drawn), share) if 0 < share < 1 else (None, share)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), n_lines.

    labels: doc_id, quality (0 or 1). The field learns from at most `sample` labelled documents that are
    not held out; labels, language, source and id are no inputs of a score. Every row is scored from its
    whole text in one narrow pass. Null or empty text: one empty line. Labels without id or quality: not
    used; of repeated labels the higher counts. Without both classes in the sample every score is the
    share of label 1 in it, 0.5 if it is empty. Repeated rows and null ids (held out): a row each.
    Empty table: no rows. Other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    read = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return _scored(read, *_fitted(rows, labels, sample), threshold)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that `quality` predicts to be good, as they are. The rows travel with their scores, so
    nothing is shuffled. The cases are those of `quality`."""
    rows = texts(docs, id_col, text_col)
    read = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _scored(read, *_fitted(rows, labels, sample), threshold).filter("predicted = 1").select("row.*")


def _scored(read: DataFrame, model: QualityModel | None, flat: float, threshold: float) -> DataFrame:
    """The columns of `read` except text, with score, predicted and n_lines."""
    carried = [f for f in read.schema.fields if f.name != "text"]

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = lines_of(batch.column("text").cast(pa.binary()).to_pylist())
        score = model.scores(lines) if model else np.full(batch.num_rows, flat)
        count = np.diff(np.append(lines.first, len(lines.own)))
        return pa.RecordBatch.from_arrays([
            *(batch.column(f.name) for f in carried), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)),
            pa.array(count.astype(np.int64))], [*(f.name for f in carried), "score", "predicted", "n_lines"])

    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_lines", T.LongType())]
    return read.mapInArrow(per_step(scored), T.StructType([*carried, *made]))


def line_labels(model: QualityModel, text: str) -> list[tuple[str, float]]:
    """Each line of a text with its marginal of being good."""
    lines = lines_of([text.encode()])
    return list(zip(text.split("\n"), model.line_marginals(lines).tolist(), strict=True))
