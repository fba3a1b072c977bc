"""Quality grades by a cumulative-link model over hashed text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import Words, fold_table, mix, owners, slices, text_bytes
from corpusforge.llm.folds import sample_by_label

WORD_BITS = 15
FIGURES = 8
MOST_GRADES = 50


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of each text: numbers, values, and offsets of the texts.

    Hashed words and hashed shapes of words (upper case, digits, last sign, length, same as the word
    before), each group scaled to length 1, then a few figures of the whole text. A text without
    words has figures only.
    """
    n = len(offsets) - 1
    words = Words(raw, offsets, fold_table())
    hashes = words.hashes()
    owner = owners(words.first, np.arange(len(hashes)))
    counts = np.maximum(np.diff(words.first), 1).astype(float)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    signs = np.concatenate([[0], np.cumsum((raw > 32) & (raw < 127) & ~(((raw | 32) >= 97) & ((raw | 32) <= 122)) & ~((raw >= 48) & (raw <= 57)))])
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    size = words.end - words.start
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    last = raw[words.end - 1] if len(size) else np.zeros(0, np.uint8)
    letter = (((last | 32) >= 97) & ((last | 32) <= 122)) | (last >= 128)
    caps = upper[words.end] - upper[words.start]
    shape = np.where(letter, 0, last.astype(np.int64)) * 64 + np.minimum(size // 4, 3) * 16 + np.minimum(caps, 2) * 4 + (digit[words.end] > digit[words.start]) * 2 + same
    top = np.uint64((1 << WORD_BITS) - 1)
    keys = np.concatenate([(mix(hashes) & top).astype(np.int64), ((mix(shape.astype(np.uint64) + np.uint64(1)) & top).astype(np.int64)) + (1 << WORD_BITS)])
    whose = np.concatenate([owner, owner])
    both, tf = np.unique(whose << 32 | keys, return_counts=True)
    text, key = both >> 32, both & ((1 << 32) - 1)
    kind = (key >> WORD_BITS).astype(np.int64)
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(text * 2 + kind, value**2, 2 * n))
    value = value / norm[text * 2 + kind] if len(value) else value
    distinct = np.bincount(text[kind == 0], minlength=n)
    per = lambda total: (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    figures = np.stack(
        [
            np.ones(n),
            np.log1p(np.diff(words.first)) / 10,
            distinct / counts,
            np.bincount(owner, same, n) / counts,
            per(upper) * 5,
            per(digit) * 5,
            per(signs) * 5,
            np.minimum((lines[offsets[1:]] - lines[offsets[:-1]]) / counts * 5, 1),
        ],
        1,
    )
    base = 2 << WORD_BITS
    text = np.concatenate([text, np.repeat(np.arange(n), FIGURES)])
    key = np.concatenate([key, np.tile(base + np.arange(FIGURES), n)])
    value = np.concatenate([value, figures.ravel()])
    order = np.argsort(text, kind="stable")
    return key[order], value[order], np.searchsorted(text[order], np.arange(n + 1))


@dataclass(frozen=True)
class Model:
    """P(grade > grades[k]) = logistic(weights . features - thresholds[k]), thresholds in ascending order."""

    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        key, value, bounds = features(raw, offsets)
        score = np.add.reduceat(self.weights[key] * value, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def _fit(keys: np.ndarray, values: np.ndarray, bounds: np.ndarray, level: np.ndarray, levels: int, ridge: float, rounds: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch adaptive gradient descent on the negative log-likelihood, rows counted by `weight`."""
    n, dims = len(level), (2 << WORD_BITS) + FIGURES
    weight = np.ones(n) if weight is None else weight / weight.mean()
    row = np.repeat(np.arange(n), np.diff(bounds))
    w = np.zeros(dims)
    share = np.array([((level > k) * weight).mean() for k in range(levels - 1)])
    cuts = -np.log(share / (1 - share))
    first, gaps = cuts[0], np.log(np.expm1(np.maximum(np.diff(cuts), 1e-3)))
    params = np.concatenate([w, [first], gaps])
    seen = np.full(len(params), 1e-8)
    for _ in range(rounds):
        w, first, gaps = params[:dims], params[dims], params[dims + 1 :]
        theta = first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps)))])
        score = np.add.reduceat(w[keys] * values, bounds[:-1])
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -30, 30)))
        # P(level) is a difference of neighbouring tail probabilities.
        tail = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        p = np.maximum(tail[np.arange(n), level] - tail[np.arange(n), level + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        up, down = weight * slope[np.arange(n), level] / p, weight * slope[np.arange(n), level + 1] / p
        to_score = -(up - down) / n
        to_theta = np.zeros(levels + 1)
        np.add.at(to_theta, level, up / n)
        np.add.at(to_theta, level + 1, -down / n)
        to_theta = to_theta[1:levels]
        to_gaps = np.cumsum(to_theta[::-1])[::-1][1:] / (1 + np.exp(-gaps))
        gradient = np.concatenate([np.bincount(keys, to_score[row] * values, dims) + ridge * w, [to_theta.sum()], to_gaps])
        seen += gradient**2
        params = params - 0.3 * gradient / np.sqrt(seen)
    theta = params[dims] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(params[dims + 1 :])))])
    return params[:dims], theta


def train(rated: DataFrame, docs: DataFrame, grade: str = "quality", most: int = 6_000, ridge: float = 1e-5, rounds: int = 300) -> Model:
    """Fit to `rated` (doc_id and grade) rows and their texts, at most `most` of each grade, first by a hash of doc_id.

    Grades are the distinct non-null values, at most 50, of documents that have a text: a grade of which no
    document is there is not learned. All such labels are counted, and a sampled row weighs as many as
    its grade has for each one drawn, so the likelihood sees the shares of all labels whatever the
    bound. With fewer than two grades the model knows that one grade only.
    """
    rated = rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("double").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    there = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    rated = rated.groupBy("doc_id").agg(F.max("grade").alias("grade")).join(there, "doc_id", "left_semi")
    labels = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().limit(MOST_GRADES + 1).collect()}
    grades = sorted(labels)
    if len(grades) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades")
    if len(grades) < 2:
        return Model(tuple(grades), np.zeros((2 << WORD_BITS) + FIGURES), np.zeros(0))
    ids = sample_by_label(rated, "grade", dict.fromkeys(grades, most)).collect()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, grade double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, value, bounds = features(*text_bytes(batch.column("text")))
            cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            columns = [batch.column("doc_id"), batch.column("grade"), pa.array([key[a:b].astype(np.int32).tobytes() for a, b in cut]), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in cut])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grade", "keys", "values"])

    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = sorted(texts.mapInArrow(run, "doc_id long, grade double, keys binary, values binary").collect(), key=lambda r: (r["doc_id"], r["keys"]))
    level = np.array([grades.index(r["grade"]) for r in rows])
    keys, values = np.frombuffer(b"".join(r["keys"] for r in rows), np.int32), np.frombuffer(b"".join(r["values"] for r in rows), np.float32)
    bounds = np.concatenate([[0], np.cumsum([len(r["keys"]) // 4 for r in rows])])
    drawn = Counter(r["grade"] for r in ids)
    weight = np.array([labels[r["grade"]] / drawn[r["grade"]] for r in rows])
    weights, thresholds = _fit(keys.astype(np.int64), values.astype(float), bounds, level, len(grades), ridge, rounds, weight)
    return Model(tuple(grades), weights, thresholds)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, predicted_grade, top_probability and tail (P(grade > g) for each grade but the last).

    Whole texts are read. Null and empty texts are graded by their figures. With one grade known it is
    everybody's, with none all are null. Null ids stay, repeated rows give their row each, an empty
    table gives none, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.array(model.grades)
        for batch in slices(batches):
            n = len(batch)
            if len(values) < 2:
                same = pa.array([float(values[0]) if len(values) else None] * n, pa.float64())
                columns = [same, same, pa.array([1.0 if len(values) else None] * n, pa.float64()), pa.array([[]] * n, pa.list_(pa.float64()))]
            else:
                above = model.above(*text_bytes(batch.column("text")))
                tail = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
                p = tail[:, :-1] - tail[:, 1:]
                columns = [pa.array(p @ values), pa.array(values[p.argmax(1)]), pa.array(above[:, -1]), pa.array(above.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "expected_grade", "predicted_grade", "top_probability", "tail"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, predicted_grade double, top_probability double, tail array<double>")
