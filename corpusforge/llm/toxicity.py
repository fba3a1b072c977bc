"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import Words, fold_table, mix, owners, prefix_hash, shingles, slices, span_hash, text_bytes
from corpusforge.llm.folds import sample_by_label
from corpusforge.llm.tokens import worker_state

ALPHABET = 32
START = 31
LONGEST = 24
SPAN = 8
DECAY = 0.7
KEEP = 500_000
# Landmarks are chosen among so many words of either kind.
CANDIDATES = 600

# Digits and signs that are written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _letter_codes() -> np.ndarray:
    """Byte to letter: a-z are 1-26, bytes within a longer character 27-30, anything else 0 (skipped)."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    for sign, letter in LOOKALIKES.items():
        table[ord(sign)] = ord(letter) - 96
    table[128:192] = 27 + np.arange(64) % 4
    return table


LETTERS = _letter_codes()


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < k within a span of SPAN places of a word of n letters, and their weights DECAY ** span."""
    state = worker_state().setdefault("triples", {})
    if n not in state:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
        index = np.array(at, np.int64).reshape(-1, 3)
        state[n] = (index, DECAY ** (index[:, 2] - index[:, 0] + 1.0))
    return state[n]


def spell(word: str) -> np.ndarray:
    codes = LETTERS[np.frombuffer(word.encode(), np.uint8)]
    return np.concatenate([[START], codes[codes > 0][: LONGEST - 1]]).astype(np.int64)


def features(spelled: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length at a time: their numbers, subsequence codes, weights and the norm of each word.

    A feature is a subsequence of three letters; its value is the sum of DECAY ** span over all its
    occurrences of at most SPAN places, so inserted letters weaken a match and do not break it.
    """
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    for n in np.unique(sizes[sizes > 2]):
        for some in np.array_split(np.flatnonzero(sizes == n), max(1, int((sizes == n).sum()) // 2_000)):
            letters = np.stack([spelled[i] for i in some])
            index, weights = _triples(int(n))
            codes = (letters[:, index[:, 0]] * ALPHABET + letters[:, index[:, 1]]) * ALPHABET + letters[:, index[:, 2]]
            order = np.argsort(codes, axis=1, kind="stable")
            ordered = np.take_along_axis(codes, order, 1)
            run = np.cumsum(weights[order], axis=1)
            last = np.ones(codes.shape, bool)
            last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
            at = np.where(last, run, 0.0)
            before = np.zeros_like(at)
            before[:, 1:] = np.maximum.accumulate(at, axis=1)[:, :-1]
            norm = np.sqrt((np.where(last, at - before, 0.0) ** 2).sum(1))
            yield some, codes, weights, norm


def vectors(words: list[str]) -> np.ndarray:
    """Normalised feature vectors of a bounded list of words."""
    out = np.zeros((len(words), ALPHABET**3), np.float32)
    for some, codes, weights, norm in features([spell(w) for w in words]):
        for row, code, size in zip(some, codes, norm):
            np.add.at(out[row], code, weights / size)
    return out


@dataclass
class Model:
    """Margin of a word: its normalised features times `weights`, plus `bias`; of a text the largest.

    `slope` and `shift` turn the margin of a text into a probability.
    """

    weights: np.ndarray
    bias: float = -1.0
    slope: float = 1.0
    shift: float = -9.0

    def margins(self, spelled: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(spelled), self.bias)
        for some, codes, weights, norm in features(spelled):
            out[some] += (self.weights[codes] @ weights) / norm
        return out

    def name(self) -> int:
        return zlib.crc32(self.weights.tobytes()) ^ zlib.crc32(np.float64(self.bias).tobytes())

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (start, end, text) of the words without outer punctuation, a long word in overlapping parts, and their hashes.

    Runs of three or more single letters are one more word from the first letter to the last.
    """
    words = Words(raw, offsets, fold_table())
    start, end = words.start.copy(), words.end.copy()
    for _ in range(8):
        cut = (end > start) & _PUNCTUATION[raw[np.maximum(end - 1, 0)]]
        end -= cut
        if not cut.any():
            break
    for _ in range(4):
        cut = (end > start) & _PUNCTUATION[raw[np.minimum(start, max(len(raw) - 1, 0))]] if len(raw) else end > start
        start += cut
        if not cut.any():
            break
    owner = owners(words.first, np.arange(len(start)))
    full = end > start
    start, end, owner = start[full], end[full], owner[full]
    single = (end - start) == 1
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            cuts = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1), b]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo >= 3:
                    start, end, owner = np.append(start, start[lo]), np.append(end, end[hi - 1]), np.append(owner, owner[lo])
    long = np.flatnonzero(end - start > LONGEST)
    if len(long):
        parts = [(s, min(s + LONGEST, end[i]), owner[i]) for i in long for s in range(start[i], end[i] - LONGEST // 2, LONGEST // 2)]
        keep = np.ones(len(start), bool)
        keep[long] = False
        more = np.array(parts, np.int64)
        start, end, owner = (np.concatenate([x[keep], more[:, k]]) for k, x in enumerate((start, end, owner)))
    return start, end, owner, span_hash(prefix_hash(words.folded), start, end)


def text_margins(raw: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Largest word margin of each text; each distinct word is worked out once per Python worker."""
    start, end, owner, hashes = _tokens(raw, offsets)
    out = np.full(len(offsets) - 1, model.bias)
    if not len(hashes):
        return out
    state = worker_state()
    known, margins = state.get(("toxicity", model.name()), (np.zeros(0, np.uint64), np.zeros(0)))
    if len(known) > KEEP:
        known, margins = known[:0], margins[:0]
    unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    spot = np.searchsorted(known, unique)
    new = np.ones(len(unique), bool)
    within = spot < len(known)
    new[within] = known[spot[within]] != unique[within]
    if new.any():
        spelled = []
        for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist()):
            codes = LETTERS[raw[a:b]]
            spelled.append(np.concatenate([[START], codes[codes > 0][: LONGEST - 1]]).astype(np.int64))
        known, margins = np.concatenate([known, unique[new]]), np.concatenate([margins, model.margins(spelled)])
        order = np.argsort(known, kind="stable")
        known, margins = known[order], margins[order]
        state["toxicity", model.name()] = (known, margins)
        spot = np.searchsorted(known, unique)
    np.maximum.at(out, owner, margins[spot][which])
    return out


def _fit_svm(z: np.ndarray, y: np.ndarray, cost: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, both classes weighing the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x = np.hstack([z, np.ones((len(z), 1))])
    w = fast = np.zeros(x.shape[1])
    ridge = np.append(np.full(z.shape[1], 1 / cost), 0.0)
    step = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + 1 / cost)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ fast))
        following = fast - step * (ridge * fast - 2 * x.T @ (weight * y * slack))
        fast = following + t / (t + 3) * (following - w)
        w = following
    return w[:-1], float(w[-1])


def _landmarks(words: list[str], count: int) -> np.ndarray:
    """Vectors of words far from each other: each next one is worst covered by those before."""
    matrix = vectors(words)
    chosen, cover = [0], matrix @ matrix[0]
    while len(chosen) < min(count, len(words)):
        worst = int(cover.argmin())
        if cover[worst] > 0.999:
            break
        chosen.append(worst)
        cover = np.maximum(cover, matrix @ matrix[worst])
    return matrix[chosen]


def fit_words(positive: list[str], negative: list[str], landmarks: int = 96, cost: float = 1e4) -> Model:
    """Machine over words: Nystrom features from landmarks of both kinds, folded back into weights of subsequences."""
    words = positive + negative
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    base = np.concatenate([_landmarks(positive[:CANDIDATES], landmarks), _landmarks(negative[:CANDIDATES], landmarks)]).astype(np.float64)
    values, basis = np.linalg.eigh(base @ base.T)
    keep = values > 1e-8 * values[-1]
    fold = base.T @ (basis[:, keep] / np.sqrt(values[keep]))
    # Few words at a time: a vector has a place for every subsequence.
    z = np.concatenate([vectors(words[k : k + 250]) @ fold for k in range(0, len(words), 250)])
    w, bias = _fit_svm(z, y, cost)
    return Model((fold @ w).astype(np.float32), bias)


def _probability_line(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over margin (Platt's targets), rows counted by `weight`."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target, a, b = np.where(y > 0, high, low), 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - target) * margin).sum(), (weight * (p - target)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(h, g)
        a, b = a - change[0], b - change[1]
        if np.abs(change).max() < 1e-6:
            break
    return float(a), float(b)


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of either label a word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            start, end, owner, hashes = _tokens(raw, offsets)
            _, first = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_index=True)
            data, labels = raw.tobytes(), batch.column("toxic").to_pylist()
            for i in first.tolist():
                counts[labels[owner[i]]][data[start[i] : end[i]].decode("utf-8", "ignore").lower()] += 1
        words = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    parts = sample.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _distinct_ids(sample: DataFrame) -> DataFrame:
    """One document of those that share label and least hash of three words: copies should not vote often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*text_bytes(batch.column("text")), fold_table())
            hashes = words.hashes()
            runs, place = shingles(hashes, words.first, 3)
            least = np.full(len(batch), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, owners(words.first, place), runs)
            # Texts of one or two words stand for themselves.
            short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < 3))
            least[short] = mix(hashes[words.first[short]] + hashes[words.first[short + 1] - 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least.view(np.int64))], names=["doc_id", "toxic", "least"])

    parts = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, least long")
    return parts.groupBy("toxic", "least").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")


def train(labelled: DataFrame, docs: DataFrame, most_toxic: int = 10_000, most_clean: int = 40_000, most_words: int = 600, evidence: float = 24.0) -> Model:
    """Learn from `labelled` (doc_id, toxic) rows and their texts.

    At most `most_toxic` and `most_clean` labelled documents are used, chosen by a hash of doc_id, and
    of near copies with one label one. Words that stand in toxic texts far more often than chance has
    them (log-likelihood ratio above `evidence`) are the positive examples, at most `most_words`;
    negative ones are drawn from the other words, and those the first machine finds most toxic are added
    for a second. The probability curve is fitted to the largest margins of the sampled texts.
    The labels of either kind are counted over all rows: where a bound cuts, each sampled text weighs as
    many as it stands for, in the share of toxic texts a word needs (0.8) and in the probability curve.
    The likelihood ratio stays one of sampled texts, as that is the evidence there is, and whether
    a word goes with a label does not depend on how many texts of either are drawn.
    Without labels of both kinds nothing is toxic.
    """
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    rows = sample_by_label(labelled, "toxic", {1: most_toxic, 0: most_clean}).collect()
    spark, none = docs.sparkSession, Model(np.zeros(ALPHABET**3, np.float32))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    def of(ids) -> DataFrame:
        """Texts of at most most_toxic + most_clean ids."""
        return texts.join(F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int")), "doc_id")

    if len({r["toxic"] for r in rows}) < 2:
        return none
    stands = {k: labels[k] / n for k, n in Counter(r["toxic"] for r in rows).items()}
    rows = _distinct_ids(of(rows)).collect()
    toxic, clean = sum(r["toxic"] for r in rows), sum(1 - r["toxic"] for r in rows)
    if not toxic or not clean:
        return none
    counts = _word_counts(of(rows)).filter(F.length("word") > 2).persist()
    share = toxic / (toxic + clean)
    both = F.col("toxic") + F.col("clean")
    mostly = F.col("toxic") * stands[1] > 0.8 * (F.col("toxic") * stands[1] + F.col("clean") * stands[0])
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))

    def strong(table: DataFrame) -> DataFrame:
        return table.filter((F.col("toxic") > 2) & mostly).withColumn("g", ratio).filter(F.col("g") > evidence)

    # An insult may come in many endings, each too rare to stand out: beginnings are counted as well.
    begins = counts.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.substring("word", F.lit(1), n)))).alias("begin"), "toxic", "clean")
    begins = strong(begins.groupBy("begin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))).orderBy(F.desc("g"), "begin").limit(most_words)
    begins = F.broadcast(spark.createDataFrame(begins.select("begin", "g").collect(), "begin string, g double"))
    under = counts.filter("toxic > 0 AND clean = 0").join(begins, F.col("word").startswith(F.col("begin"))).select("word", "g")
    found = strong(counts).select("word", "g").union(under).groupBy("word").agg(F.max("g").alias("g"))
    positive = [r["word"] for r in found.orderBy(F.desc("g"), "word").limit(most_words).collect()]
    if not positive:
        counts.unpersist()
        return none
    other = counts.filter("clean > 0").filter(~mostly)
    drawn = [r["word"] for r in other.orderBy(F.xxhash64("word"), "word").limit(2500).collect()]
    common = [r["word"] for r in other.orderBy(F.desc("clean"), "word").limit(1500).collect()]
    negative = list(dict.fromkeys(common + drawn))
    if not negative:
        counts.unpersist()
        return none
    model = fit_words(positive, negative)
    for _ in range(2):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column("word").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(model.margins([spell(w) for w in words]))], names=["word", "margin"])

        hard = other.select("word").mapInArrow(run, "word string, margin double").orderBy(F.desc("margin"), "word").limit(1500).collect()
        negative = list(dict.fromkeys(negative + [r["word"] for r in hard]))
        model = fit_words(positive, negative)
    counts.unpersist()
    margins = of(rows).select("text", "toxic").mapInArrow(_margin_rows(model, ["toxic"]), "toxic int, margin double").collect()
    weight = np.array([stands[r["toxic"]] for r in margins])
    model.slope, model.shift = _probability_line(np.array([r["margin"] for r in margins]), np.array([float(r["toxic"]) for r in margins]), weight)
    return model


def _margin_rows(model: Model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            margins = text_margins(*text_bytes(batch.column("text")), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(margins)], names=[*kept, "margin"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document, from its whole text.

    A text scores by its most toxic word (a longer word in overlapping parts; single letters in a
    row count as one). Null, empty and wordless texts get the score of no evidence. Null ids stay, repeated
    rows give their row each, an empty table gives none, other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    margins = rows.mapInArrow(_margin_rows(model, ["doc_id"]), "doc_id long, margin double")
    value = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("margin") * model.slope + model.shift))))
    scored = margins.select("doc_id", value.alias("score"), "margin")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents not predicted toxic, with all their columns."""

    def margins(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        parts = [text_margins(*text_bytes(b.column("text")), model) for b in slices(iter([batch]), most=2 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    margins.__annotations__ = {"text": pa.Array, "return": pa.Array}
    margin = F.arrow_udf(margins, "double")
    return docs.filter(F.coalesce(margin(F.col("text").cast("string")) * model.slope + model.shift < 0, F.lit(True)))
