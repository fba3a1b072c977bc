"""Near copies by verified similarity: SimHash searches propose families, exact shingle sets decide.

One 64-bit fingerprint parts texts that share 80 % of their shingles by up to 14 bits, and so far out unlike texts are
near as well. Several independent fingerprints of the same shingles are searched at a short distance each instead:
near copies come close in at least one of them, unlike texts in none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import Words, fold_table, give_back, mix, owners, shingles, slices, text_bytes
from corpusforge.llm.components import connect
from corpusforge.llm.simhash import BROADCAST_ROWS, _spanning, links
from corpusforge.llm.tokens import forget
from corpusforge.session import discard, materialize

PRINTS = 7
DISTANCE = 7
#: Texts of one block of a family; a tile compares two blocks.
BLOCK = 512
#: Bytes of text whose shingles are in memory at once, with 64 counters each.
SLICE = 1 << 19


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `size` words (A-Z in lower case), and the text each is of; a shorter text is one run."""
    words = Words(raw, offsets, fold_table())
    hashes = words.hashes()
    runs, place = shingles(hashes, words.first, size)
    owner = owners(words.first, place)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for i in range(size - 1):
        some = counts[short] > i
        whole[some] = mix(whole[some] * np.uint64(3) + hashes[words.first[short[some]] + i])
    return np.concatenate([runs, whole]), np.concatenate([owner, short])


def majority_prints(hashes: np.ndarray, owner: np.ndarray, n: int, prints: int) -> np.ndarray:
    """`prints` 64-bit SimHash values per text; zero for a text without shingles."""
    out = np.zeros((prints, n), np.uint64)
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    full, start = np.unique(owner, return_index=True)
    if not len(full):
        return out
    total = np.diff(start, append=len(owner))
    for i in range(prints):
        bits = np.unpackbits(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[i, full] = np.packbits(2 * ones > total[:, None], axis=1).view(np.uint64).ravel()
    return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _prints(docs: DataFrame, size: int, prints: int) -> DataFrame:
    """text_key, empty (no word) and the fingerprints p0, p1, ... of every different text."""
    names = [f"p{i}" for i in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, most=SLICE):
            hashes, owner = shingle_hashes(*text_bytes(batch.column("text")), size)
            found = majority_prints(hashes, owner, len(batch), prints)
            empty = np.bincount(owner, minlength=len(batch)) == 0
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(empty), *(pa.array(p.view(np.int64)) for p in found)], names=["text_key", "empty", *names])

    rows = _texts(docs).select("text_key", "text").mapInArrow(run, "text_key long, empty boolean, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("text_key").agg(F.first("empty").alias("empty"), *[F.first(n).alias(n) for n in names])


def families(prints: DataFrame, count: int, distance: int) -> DataFrame:
    """(node, root) of texts that may be near copies: within `distance` bits in one of the fingerprints, or linked so.

    All kinds of fingerprints are searched at once, each among its own.
    """
    kinds = F.posexplode(F.array(*[F.col(f"p{i}") for i in range(count)])).alias("kind", "fingerprint")
    rows = materialize(prints.select("text_key", kinds), "print-rows")
    own = materialize(rows.groupBy("kind", "fingerprint").agg(F.min("text_key").alias("node"), F.count("*").alias("n")), "prints")
    equal = rows.join(own.filter("n > 1"), ["kind", "fingerprint"]).select(F.col("text_key").alias("u"), F.col("node").alias("v"))
    found = links(own, distance, kinds=count)
    # A value that two kinds share names a text too many: one more candidate, which the exact check refuses.
    near = found.join(own.select(F.col("fingerprint").alias("u"), F.col("node").alias("_u")), "u").join(own.select(F.col("fingerprint").alias("v"), F.col("node").alias("_v")), "v")
    roots = connect(equal.union(near.select("_u", "_v")))
    discard(rows)
    return roots


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the pairs of sorted distinct sets whose Jaccard similarity is `least` or more."""
    n, size = len(sets), np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), 4096):
        at = slice(*np.searchsorted(column, [start, start + 4096]))
        has = np.zeros((n, 4096), np.float32)
        has[row[at], column[at] - start] = 1
        common += has @ has.T
    a, b = np.nonzero(np.triu(common >= least * (size[:, None] + size[None, :] - common) - 1e-3, 1))
    return _spanning(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)), [(a, b)])


def verified(docs: DataFrame, members: DataFrame, size: int, least: float, block: int) -> DataFrame:
    """Links (u, v) that span the families' texts of `least` Jaccard similarity of their sets of shingles, and more.

    A family of any size is dealt out as pairs of blocks, so a task holds the sets of two blocks; all pairs of a
    tile are compared and only spanning links leave it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, owner = shingle_hashes(*text_bytes(batch.column("text")), size)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
            hashes, owner = hashes[first], owner[first]
            edges = np.searchsorted(owner, np.arange(len(batch) + 1))
            data = hashes.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("root"), pa.array(sets, pa.binary())], names=["text_key", "root", "shingles"])

    told = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    named = _texts(docs).join(told, F.col("text_key") == F.col("node")).select("text_key", "root", "text")
    sets = materialize(named.mapInArrow(cut, "text_key long, root long, shingles binary").dropDuplicates(["text_key"]), "shingle-sets")
    sizes = sets.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = sets.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("text_key", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = ["root", "a", "b"]
    rows = rows.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "text_key", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held = None, [], []

        def linked() -> pa.RecordBatch:
            u, v = similar(held, least) if len(held) > 1 else ([], [])
            names = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[u] if len(held) > 1 else [], pa.int64()), pa.array(names[v] if len(held) > 1 else [], pa.int64())], names=["u", "v"])

        for batch in batches:
            for key, text, shingles_ in zip(zip(*(batch.column(c).to_pylist() for c in tile)), batch.column("text_key").to_pylist(), batch.column("shingles")):
                if key != now and held:
                    yield linked()
                    keys, held = [], []
                now = key
                keys.append(text)
                held.append(np.frombuffer(shingles_.as_py(), np.uint64))
        if held:
            yield linked()
        held.clear()
        give_back()

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(compare, "u long, v long")


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8, prints: int = PRINTS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key and component of every document: texts linked by `least` similarity of their sets of `size`-word shingles.

    Equal texts share a component. Pairs are proposed by SimHash and verified exactly (shingles are told apart by 64-bit
    hashes): no unlike texts are linked; a pair is missed only if it is further than `distance` bits in every
    fingerprint and no third text links the two families. Texts without a word are copies of each other.
    Null text is empty. Null ids stay, repeated rows give their row each, other columns are not looked at,
    an empty table gives no rows.
    """
    found = materialize(_prints(docs, size, prints), "text-prints")
    members = materialize(families(found.filter("NOT empty"), prints, distance), "families")
    roots = connect(verified(docs, members, size, least, block))
    blank = found.filter("empty").select(F.col("text_key").alias("node"))
    least_blank = blank.agg(F.min("node").alias("m")).first()["m"]
    named = materialize(roots.union(blank.withColumn("root", F.lit(least_blank).cast("long"))), "near-copies")
    discard(found, members)
    rows = _texts(docs).select("doc_id", "text_key")
    return rows.join(named, rows["text_key"] == named["node"], "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("component"))


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """The documents, one per component of `near_copies`: that of the least doc_id (nulls last), all its columns kept.

    What goes is taken out by doc_id and a hash of the text; texts move only where more rows go than may be
    told to all executors, or to drop repeated rows.
    """
    found = materialize(near_copies(docs, **settings), "components")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    first = found.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("n")).filter("n > 1").select("component", F.col("o.b").alias("_id"), F.col("o.c").alias("_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    gone = found.join(first, "component").filter(~stays).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = materialize(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    text_key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (text_key == gone["_key"]), "left_anti")
    repeated = found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
