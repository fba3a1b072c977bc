"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import slices, text_bytes
from corpusforge.llm.folds import sample_by_label
from corpusforge.llm.tokens import worker_state
from corpusforge.session import discard, materialize

UNKNOWN = "und"
# Texts are parsed in stretches of this many bytes side by side; a phrase ends where its stretch ends. That
# adds about 0.1 % phrases; tests compare with phrases that run on.
STRETCH = 1024
SHARPNESS = 4.0


def _letters() -> np.ndarray:
    """Byte to byte: letters in lower case, bytes of longer characters as they are, anything else a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def plain(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as letters and single spaces, without a space in front."""
    folded = LETTERS[raw]
    keep = folded != 32
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    keep[1:] |= (folded[:-1] != 32) & ~first[1:-1]
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class Automaton:
    """All substrings of a text: one state per class of them, `table[state, letter]` the next state or -1."""

    def __init__(self, letters: np.ndarray, alphabet: int):
        follow: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for letter in letters.tolist():
            now = len(follow)
            follow.append({})
            size.append(size[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and letter not in follow[at]:
                follow[at][letter] = now
                at = link[at]
            if at >= 0:
                there = follow[at][letter]
                if size[at] + 1 == size[there]:
                    link[now] = there
                else:
                    twin = len(follow)
                    follow.append(dict(follow[there]))
                    size.append(size[at] + 1)
                    link.append(link[there])
                    while at >= 0 and follow[at].get(letter) == there:
                        follow[at][letter] = twin
                        at = link[at]
                    link[there] = link[now] = twin
            last = now
        self.table = np.full((len(follow), alphabet), -1, np.int32)
        for state, steps in enumerate(follow):
            if steps:
                self.table[state, list(steps)] = list(steps.values())


@dataclass(frozen=True)
class Model:
    """Learned languages, their plain training bytes, and the letter numbers of bytes (0: never seen)."""

    languages: tuple[str, ...]
    texts: tuple[bytes, ...]
    codes: bytes

    def machines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """One flat table of all automata, their first states, and bits of a phrase; built once per Python worker."""
        state, name = worker_state(), ("language", zlib.crc32(b"".join(self.texts)), self.languages)
        if name not in state:
            codes = np.frombuffer(self.codes, np.uint8)
            alphabet = int(codes.max()) + 1
            tables = [Automaton(codes[np.frombuffer(t, np.uint8)], alphabet).table for t in self.texts]
            roots = np.cumsum([0, *(len(t) for t in tables[:-1])])
            flat = np.concatenate([np.where(t >= 0, t + r, -1) for t, r in zip(tables, roots)]).astype(np.int32)
            state[name] = (flat.ravel(), roots.astype(np.int32), np.log2([max(2, len(t)) for t in self.texts]), alphabet)
        return state[name]


def fill_level(sizes: list[int], total: int) -> int:
    """The most that every text may give so that all together give at most `total`: short texts give all they
    have, and what they leave goes to longer ones."""
    left = total
    for i, size in enumerate(sorted(sizes)):
        rest = len(sizes) - i
        if size * rest >= left:
            return left // rest
        left -= size
    return max(sizes, default=0)


def train(labelled: DataFrame, documents: int = 150, letters: int = 50_000) -> Model:
    """Learn every non-null lang of `labelled` (doc_id, text, lang).

    Per language at most `documents` texts, first by a hash of doc_id (of rows that share a doc_id and lang the
    greatest text), and `letters` bytes of letters. A text gives its middle, all of it where the bound allows:
    five long texts fill the bound as well as 150 short ones.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model((), (), b"\0" * 256)
    spark = labelled.sparkSession
    ids = sample_by_label(rows.select("doc_id", "lang"), "lang", dict.fromkeys(languages, documents)).collect()
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, lang string").distinct())
    # One text per chosen document; only the longest possible share of it goes on.
    texts = rows.join(chosen, ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.max("text").alias("text"))
    texts = texts.select("lang", "doc_id", _middle(F.regexp_replace("text", r"[^\p{L}]+", " "), F.lit(letters)).alias("text"))
    texts = materialize(texts, "language-texts")
    sizes = texts.select("lang", F.octet_length("text").alias("size")).collect()
    levels = [(each, fill_level([r["size"] for r in sizes if r["lang"] == each], letters)) for each in languages]
    parts = texts.join(F.broadcast(spark.createDataFrame(levels, "lang string, level long")), "lang")
    cut = parts.select("lang", "doc_id", _middle(F.col("text"), F.col("level")).alias("text")).collect()
    discard(texts)
    out = []
    for language in languages:
        raw = b" ".join(r["text"].encode() for r in sorted((r for r in cut if r["lang"] == language), key=lambda r: r["doc_id"]))
        out.append(plain(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes())
    seen = sorted(set(b"".join(out)))
    codes = np.zeros(256, np.uint8)
    codes[seen] = np.arange(1, len(seen) + 1)
    return Model(tuple(languages), tuple(out), codes.tobytes())


def _middle(text: Column, size: Column) -> Column:
    """About `size` bytes from the middle of a text, in whole characters."""
    length, stored = F.length(text), F.octet_length(text)
    n = F.ceil(F.least(F.lit(1.0), size / F.greatest(stored, F.lit(1))) * length).cast("int")
    return F.substring(text, F.floor((length - n) / 2).cast("int") + 1, n)


def phrases(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each text falls into, per language, and plain lengths.

    A phrase is the longest match from where it starts; the letter that ends it starts the next. All
    stretches of all texts and all languages step together.
    """
    flat, roots, _, alphabet = model.machines()
    letters, bounds = plain(raw, offsets)
    letters = np.frombuffer(model.codes, np.uint8)[letters]
    lengths = np.diff(bounds)
    pieces = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[owner] + rank * STRETCH
    size = np.minimum(STRETCH, bounds[owner + 1] - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    active = np.searchsorted(-size, -np.arange(STRETCH), "left")
    count = np.ones((len(roots), len(owner)), np.int32)
    state = np.repeat(roots[:, None], len(owner), axis=1)
    at_root = roots[:, None].astype(np.int64) * alphabet
    for step in range(int(size[0]) if len(size) else 0):
        n = int(active[step])
        letter = letters[start[:n] + step].astype(np.int64)
        following = flat[state[:, :n].astype(np.int64) * alphabet + letter]
        stuck = following < 0
        if step:
            # A machine at its first state has just passed a letter it has never seen: a phrase of its own.
            count[:, :n] += stuck | (state[:, :n] == roots[:, None])
        if stuck.any():
            again = flat[(at_root + letter)[stuck]]
            following[stuck] = np.where(again < 0, np.broadcast_to(roots[:, None], stuck.shape)[stuck], again)
        state[:, :n] = following
    total = np.zeros((len(roots), len(lengths)))
    for language in range(len(roots)):
        total[language] = np.bincount(owner, count[language], len(lengths))
    return total, lengths


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text.

    The language whose text parses the document into the fewest phrases, each weighed by the bits of a
    place in that language's text, wins; ties go to the first by name. Score is its share when
    bits per letter are turned into odds. Phrases end at every `STRETCH` bytes of letters, alike for all
    languages, so a long text has a few more of them than one unbroken parse. `und` with score 0 if the text is null or has no
    letter, or nothing was learned. Null ids stay, repeated rows give their row each, an empty table
    gives none, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            if model.languages:
                count, lengths = phrases(raw, offsets, model)
                bits = count * model.machines()[2][:, None] / np.maximum(lengths, 1)
                odds = np.exp(-SHARPNESS * (bits - bits.min(0)))
                ascii_letters = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128))])
                lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~lettered & (lengths > 0)):
                    lettered[i] = any(c.isalpha() for c in batch.column("text")[int(i)].as_py() or "")
                best[lettered] = bits.argmin(0)[lettered]
                score[lettered] = (odds.max(0) / odds.sum(0))[lettered]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
