"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier over hashed byte n-grams learns each bit.
A text's margins are decoded to the codeword of the least loss, each bit weighted by how well its
classifier separates the sample; two codewords of nearly the same loss are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import STEP_CHARS, held_out, steps

#: Counters for pairs and for triples of bytes.
PAIRS, TRIPLES = 2048, 2048
#: Texts of one step, so that its counters stay small.
STEP_ROWS = 512
#: The fit: expected documents in the sample, and for each language where they are many.
SAMPLE, EACH = 1200, 3
RIDGE, AMBIGUOUS = 1e-3, 0.1
UNKNOWN = "und"


def _folded() -> np.ndarray:
    """Bytes with ASCII letters in lower case and other ASCII as a space."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    for b in range(97, 123):
        table[b] = table[b - 32] = b
    return table


FOLDED = _folded()


def features(values: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts of whole texts, square roots, rows of length 1."""
    lengths = np.array([len(v) for v in values], np.int64)
    data = FOLDED[np.frombuffer(b"".join(values), np.uint8)]
    row = np.repeat(np.arange(len(values)), lengths)
    out = np.zeros((len(values), PAIRS + TRIPLES), np.float32)
    if len(data) > 1:
        pair = data[:-1] | data[1:] << np.uint32(8)
        inside = row[:-1] == row[1:]
        slot = (pair * np.uint32(2654435761)) >> np.uint32(21)
        counts = np.bincount((row[:-1] * PAIRS + slot)[inside], minlength=len(values) * PAIRS)
        out[:, :PAIRS] = counts.reshape(len(values), PAIRS)
    if len(data) > 2:
        triple = pair[:-1] | data[2:] << np.uint32(16)
        inside = row[:-2] == row[2:]
        slot = (triple * np.uint32(2246822519)) >> np.uint32(21)
        counts = np.bincount((row[:-2] * TRIPLES + slot)[inside], minlength=len(values) * TRIPLES)
        out[:, PAIRS:] = counts.reshape(len(values), TRIPLES)
    out = np.sqrt(out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: of many random codes the one whose closest words are furthest apart."""
    bits = max(7, 6 * int(np.ceil(np.log2(max(n, 2)))))
    best, most = None, -1
    for seed in range(200 if n <= 50 else 20):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        if n > 1 and (np.abs(code.sum(0)) == n).any():
            continue
        apart = min(((code[i] != code[i + 1:]).sum(1).min() for i in range(n - 1)), default=bits)
        if apart > most:
            best, most = code, apart
    return best if best is not None else np.random.default_rng(0).choice([-1.0, 1.0], (n, bits))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language, per text: logistic loss of each bit's margin, weighted by trust."""
        margin = (x @ self.weights + self.bias) * 3.0
        return np.stack([(np.logaddexp(0.0, -margin * word) * self.trust).sum(1) for word in self.code], 1) / self.trust.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share (0 to 1), and whether the second is nearly as near."""
        loss = self.losses(x)
        best = loss.argmin(1)
        shares = np.exp(-8.0 * (loss - loss.min(1, keepdims=True)))
        nearest = np.sort(loss, 1)
        unclear = nearest[:, 1] - nearest[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(x), bool)
        # Rounded, because the last digits of a product follow the number of texts multiplied together.
        return best, np.round(shares[np.arange(len(x)), best] / shares.sum(1), 6), unclear


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel | None:
    """Ridge classifiers for the bits of all languages in the sample."""
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    y = code[[names.index(v) for v in langs]]
    bias = y.mean(0)
    kernel = (x @ x.T).astype(np.float64)
    kernel[np.diag_indices_from(kernel)] += RIDGE * len(x)
    weights = x.T.astype(np.float64) @ np.linalg.solve(kernel, y - bias)
    right = (np.sign(x @ weights + bias) == y).mean(0)
    return LanguageModel(names, code, weights.astype(np.float32), bias, np.maximum(right - 0.5, 0.01))


def _sample(docs: DataFrame, sample: int) -> tuple[np.ndarray, list[str]]:
    """Features and languages of about `sample` documents, or EACH for a language if those are more; chosen by a hash of
    the id and brought to the driver as n-gram counts. Of every language, however rare, at least one is chosen."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least")).orderBy("lang").collect()
    if not counts:
        return np.zeros((0, PAIRS + TRIPLES), np.float32), []
    each = max(sample / len(counts), EACH)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], max(min(1.0, each / r["n"]), r["least"]))])
    chosen = known.filter(drawn <= F.try_element_at(share, F.col("lang")))

    def counted(batches):
        for batch in batches:
            for step in steps(batch, "text"):
                for i in range(0, step.num_rows, STEP_ROWS):
                    part = step.slice(i, STEP_ROWS)
                    x = features(part.column("text").cast(pa.binary()).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    rows = chosen.mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(-1, PAIRS + TRIPLES).astype(np.float32)
    return x, [r["lang"] for r in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    The classifiers learn from a sample of about `sample` rows that are not held out and have text and
    language (EACH for a language where that is more), balanced over languages and drawn by a hash of the id; every
    language is learned, and every row is predicted from its whole text. Null text, a text without letters, or no row to learn from: `und` with score 0. Ties between
    codewords: the first language by name. Repeated rows and null ids (held out): a row each. Empty table:
    no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(*_sample(rows, sample))
    read = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean"

    def predicted(batches):
        for batch in batches:
            for step in steps(batch, "text", STEP_CHARS):
                for i in range(0, step.num_rows, STEP_ROWS):
                    part = step.slice(i, STEP_ROWS)
                    values = part.column("text").cast(pa.binary()).to_pylist()
                    if model is None:
                        best, score, unclear = [None] * len(values), [0.0] * len(values), [False] * len(values)
                    else:
                        best, score, unclear = model.decode(features([v or b"" for v in values]))
                    none = [v is None or model is None for v in values]
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), part.column("held_out"),
                        pa.array([UNKNOWN if skip else model.languages[b] for skip, b in zip(none, best, strict=True)], pa.string()),
                        pa.array([0.0 if skip else float(s) for skip, s in zip(none, score, strict=True)], pa.float64()),
                        pa.array([not skip and bool(u) for skip, u in zip(none, unclear, strict=True)], pa.bool_()),
                    ], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return read.mapInArrow(predicted, schema)
