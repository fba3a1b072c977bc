"""Spelling variants: words one edit apart, found by comparing tiles of padded code-point matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

#: Words of one block of a large group; a tile compares two blocks.
BLOCK = 2048
#: Code points that a step of a tile holds at once.
CELLS = 1 << 21
_PARTIAL = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _keyed(words: DataFrame) -> DataFrame:
    """Four rows per word: as the longer or equal one (class = its length) and as the shorter one (class = length + 1), by beginning and by end.

    Of two words one edit apart, the longer with m code points, either the first or the last m // 2 code
    points agree: before and behind the edit m - 1 of them agree. So the two meet under one of those keys.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - half + 1, half).alias("part")))
    rows = rows.select("word", "n", "m", F.explode(ends).alias("end"))
    return rows.select("word", "n", "m", "end.side", F.xxhash64("end.side", "end.part").alias("part"))


def _tiles(keyed: DataFrame, block: int) -> DataFrame:
    """Rows of (m, side, part, a, b): tile (a, b) holds the words of blocks a and b of its group. Words alone in a group go."""
    key = ["m", "side", "part"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    rows = keyed.join(sizes, key)
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("word", "n", *key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")


def code_points(words: pa.Array, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices of the words' code points, padded with zeros: aligned left and aligned right."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    if not len(flat) or flat.max() < 256:
        flat = flat.astype(np.uint8)
    left, right = (np.zeros((len(sizes), width), flat.dtype) for _ in range(2))
    place = np.arange(width)
    left[place < sizes[:, None]] = flat
    right[place >= width - sizes[:, None]] = flat
    return left, right


def one_edit(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of rows are different words one edit apart, with their common beginnings and ends.

    One inserted, deleted or replaced code point is what parts two words if and only if their common
    prefix and suffix reach the longer length less one.
    """
    width = left.shape[1]
    differ = left[a] != left[b]
    prefix = np.where(differ.any(1), differ.argmax(1), width)
    differ = right[a, ::-1] != right[b, ::-1]
    suffix = np.where(differ.any(1), differ.argmax(1), width)
    shorter, longer = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    return (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & ((prefix < longer) | (shorter < longer)), prefix, suffix


def _pairs(starts: np.ndarray, ends: np.ndarray, two: np.ndarray, own: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each run of rows, at most about `most` at a time; in a tile of `two` blocks only pairs across them."""
    size = ends - starts
    # Pair row i with every later row of its run.
    row = np.arange(len(own))
    run = np.repeat(np.arange(len(starts)), size)
    later = ends[run] - row - 1
    edge = np.cumsum(later)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + most, "right")))
        a = np.repeat(row[at:stop], later[at:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(edge[at:stop] - later[at:stop] - (edge[at - 1] if at else 0), later[at:stop])
        keep = ~two[run[a]] | (own[a] != own[b])
        yield a[keep], b[keep]
        at = stop


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the tiles of sorted rows; one row per word and step with near words: how many, and the one that occurs most."""
    for rows in _whole_tiles(batches):
        m, side, part, a, b, own, n = (rows.column(c).to_numpy() for c in ("m", "side", "part", "a", "b", "own", "n"))
        words = rows.column("word").combine_chunks()
        change = np.flatnonzero((np.diff(m) != 0) | (np.diff(side) != 0) | (np.diff(part) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        starts, ends = np.append(0, change), np.append(change, len(m))
        # Tiles of one class share their width.
        first = 0
        while first < len(starts):
            width = int(m[starts[first]])
            last = int(np.searchsorted(m[starts], width, "right"))
            lo, hi = int(starts[first]), int(ends[last - 1])
            text = words.slice(lo, hi - lo)
            sizes = np.array([len(w) for w in text.to_pylist()], np.int64)
            left, right = code_points(text, sizes, width)
            half, found = width // 2, []
            for x, y in _pairs(starts[first:last] - lo, ends[first:last] - lo, (a != b)[starts[first:last]], own[lo:hi], max(1, CELLS // width)):
                y, x = y[pair := np.maximum(sizes[x], sizes[y]) == width], x[pair]
                near, prefix, suffix = one_edit(left, right, sizes, x, y)
                # Words that agree at both ends meet twice: the beginning counts.
                near &= np.where(side[lo + x] == 0, prefix >= half, (suffix >= half) & (prefix < half))
                found.append((x[near], y[near]))
            x, y = (np.concatenate(side_) for side_ in zip(*found))
            if len(x):
                yield _summary(text, n[lo:hi], np.concatenate([x, y]), np.concatenate([y, x]))
            first = last


def _summary(words: pa.Array, n: np.ndarray, word: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    names = np.array(words.to_pylist(), object)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((rank[near], -n[near], word))
    rows, first, times = np.unique(word[order], return_index=True, return_counts=True)
    best = near[order][first]
    return pa.RecordBatch.from_arrays([words.take(pa.array(rows)), pa.array(times), pa.array(n[best]), words.take(pa.array(best))], schema=_PARTIAL)


def _whole_tiles(batches: Iterator[pa.RecordBatch], cells: int = 1 << 21) -> Iterator[pa.Table]:
    """Sorted batches put together and cut between tiles; about `cells` code points, or one tile."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pa.compute.sum(batch.column("m")).as_py() or 0
        if size < cells:
            continue
        table = pa.Table.from_batches(held)
        key = [table.column(c).to_numpy() for c in ("m", "side", "part", "a", "b")]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        if not len(last):
            continue
        cut = int(last[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = sum(pa.compute.sum(b.column("m")).as_py() for b in held)
    if size:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each word with a near word: word, n_near (how many words are one edit away), best_n and best.

    `words` needs word and n, one row per word. Two words are near if they differ by exactly one inserted,
    deleted or replaced code point; `best` is the near word of largest n, of equal ones the first in
    code-point order. Words meet by half of their code points, so no list of all pairs is ever made:
    tiles go to tasks, and each gives one row per word. A group of any size is dealt out as pairs of blocks of
    about `block` words. Null words are left out; a null n counts as 0; an empty table gives none.
    """
    words = words.filter(F.col("word").isNotNull()).select(F.col("word").cast("string").alias("word"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    tiles = _tiles(_keyed(words), block)
    tile = ["m", "side", "part", "a", "b"]
    dealt = tiles.repartition(*tile).sortWithinPartitions(*tile, "own")
    partial = dealt.mapInArrow(_compare, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.w").alias("best"))


def variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """All words with their spelling form: word, form, root, n, n_near, form_n.

    The form of a word is its near word of largest n (ties: first in code-point order) if that n is at
    least `ratio` times the word's own; else null. The root follows forms to the last one; a word
    without a form is its own root. Counts grow by `ratio` from form to form, so chains are short;
    they are followed by doubling, each round written to the shared folder, and only words with a form
    take part. `ratio` must exceed 1. Null words are left out; an empty table gives none.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1, or forms could go in circles")
    words = words.filter(F.col("word").isNotNull()).select(F.col("word").cast("string").alias("word"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    has = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near_words(words, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has & (F.col("best_n") > F.col("n")), F.col("best")).alias("form"), F.when(has & (F.col("best_n") > F.col("n")), F.col("best_n")).alias("form_n")
    )
    formed = materialize(formed, "forms")
    steps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    out = formed.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def folded(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def typed_words(docs: DataFrame, least: int = 6, times: int = 5, every: int = 199) -> DataFrame:
    """Words of all texts with typing errors put in by a rule: word and n, of at least `least` code points and `times` occurrences.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. With h the crc32 of
    `<doc_id>:<run>`, a run loses its code point h modulo its length (from 0) if `every` divides h. Shorter runs
    are left out before they are counted, and counts combine before they are shuffled. Null text
    has no words; a null doc_id counts as the empty text; an empty table gives none.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(folded(F.col("text").cast("string")), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
