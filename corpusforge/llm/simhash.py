"""Near-duplicate detection by SimHash fingerprints and a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import Words, fold_table, give_back, ragged, slices, text_bytes
from corpusforge.llm.components import _roots, connect
from corpusforge.session import materialize

BITS = 64
# A bucket beyond this is dealt out in blocks of this size, block against block.
BLOCK = 4096
# Buckets known to be that few are told to all executors; else the join shuffles.
BROADCAST_ROWS = 500_000
# A row sent and sorted costs about as much as so many comparisons of two prints.
ROW_COST = 200.0


def text_fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text: words in lower case (A-Z), runs of `size` words, majority of XXH64 bits."""
    from xxhash import xxh64_intdigest

    n = len(offsets) - 1
    words = Words(raw, offsets, fold_table())
    lengths = words.end - words.start
    place = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    joined[ragged(place, lengths)] = words.folded[ragged(words.start, lengths)]
    counts = np.diff(words.first)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = ragged(words.first[:-1], per_text)
    owner = np.repeat(np.arange(n), per_text)
    last = np.minimum(first + size, words.first[owner + 1]) - 1
    data = joined.tobytes()
    hashes = np.fromiter((xxh64_intdigest(data[a:b], seed) for a, b in zip(place[first].tolist(), (place[last] + lengths[last]).tolist())), np.uint64, len(first))
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(per_text)
    if len(full):
        starts = (np.cumsum(per_text) - per_text)[full]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > per_text[full, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key (hash of the text) and fingerprint, a signed 64-bit number, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            prints = text_fingerprints(*text_bytes(batch.column("text")), size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints)], names=["doc_id", "text_key", "fingerprint"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how often both are set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
            total, n = total + bits.T @ bits, n + len(values)
        names = ["n", "both"]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().astype(np.int64)], pa.list_(pa.int64()))], names=names)

    parts = prints.select("fingerprint").mapInArrow(run, "n long, both array<long>")
    pairs = parts.select("n", F.posexplode("both").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for row in pairs:
        both[row["at"]] = row["c"]
    return (int(pairs[0]["n"]) if pairs else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal size whose bits are correlated: each grows by the free bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        sums = correlation[np.ix_(free, free)].sum(1)
        group = [free[int(sums.argmax())]]
        free.remove(group[0])
        while len(group) < size:
            best = free[int(correlation[np.ix_(free, group)].sum(1).argmax())]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, share: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of the partitions that sum to distance - parts + 1, and their estimated cost.

    Any two prints within `distance` lie within the threshold of some partition, as else they would
    differ in more bits. Cost of a threshold: pairs of prints expected within it (bits taken as
    independent, with their shares of ones over all prints) plus the probes sent for it. A threshold of
    -1 leaves the partition out. Dynamic programming over partitions and the sum so far.
    """
    target = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        differ = 2 * share[group] * (1 - share[group])
        chance = np.array([1.0])
        for q in differ:
            chance = np.convolve(chance, [1 - q, q])
        costs = {-1: 0.0}
        for t in range(0, min(distance, len(group)) + 1):
            probes = sum(comb(len(group), k) for k in range(t + 1))
            costs[t] = n * probes * ROW_COST + n * n * chance[: t + 1].sum()
        following: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, extra in costs.items():
                key = so_far + t
                if key not in following or cost + extra < following[key][0]:
                    following[key] = (cost + extra, [*chosen, t])
        best = following
    return best[target]


def plan_search(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The cheapest choice of partitions and thresholds over a few numbers of partitions."""
    share = np.diag(both) / max(n, 1)
    choices = []
    for parts in range(2, distance + 2):
        groups = group_bits(n, both, parts)
        cost, thresholds = allocate(n, share, groups, distance)
        choices.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda c: c[:2])[2]


def _masks(group: list[int], threshold: int) -> list[int]:
    """All error patterns of 1 to `threshold` bits of the group, as numbers; bit 0 is the highest."""
    bits = [1 << (BITS - 1 - b) for b in group]
    return [sum(c) for k in range(1, threshold + 1) for c in combinations(bits, k)]


def signatures(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fingerprint, probe): each print's own part values, and the values within the threshold.

    Prints of different `kind` (a column that may be missing) have parts of their own and never meet.

    Of a print and its altered value only the side whose highest altered bit is 0 probes, as the
    other print would meet it a second time.
    """
    tables = []
    for number, (group, threshold) in enumerate(plan):
        whole = np.uint64(sum(1 << (BITS - 1 - b) for b in group))
        masks = np.array(_masks(group, threshold), np.uint64)
        tables.append((np.uint64(number), whole, masks, np.array([1 << (int(m).bit_length() - 1) for m in masks], np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int32) * len(tables)
            for number, whole, masks, tops in tables:
                part = values & whole
                for start in range(0, len(values), 20_000):
                    some, own = values[start : start + 20_000], part[start : start + 20_000]
                    who, which = np.nonzero((own[:, None] & tops[None, :]) == 0) if len(masks) else (np.zeros(0, int), np.zeros(0, int))
                    keys = np.concatenate([own, own[who] ^ masks[which]])
                    flags = np.concatenate([np.zeros(len(own), bool), np.ones(len(who), bool)])
                    kind = kinds[start : start + 20_000]
                    columns = [pa.array(np.concatenate([kind, kind[who]]) + np.int32(number)), pa.array(keys.view(np.int64)), pa.array(np.concatenate([some, some[who]]).view(np.int64)), pa.array(flags)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "fingerprint", "probe"])
        give_back()

    kind = F.col("kind") if "kind" in prints.columns else F.lit(0)
    return prints.select("fingerprint", kind.cast("int").alias("kind")).mapInArrow(run, "part int, value long, fingerprint long, probe boolean")


def _verified(keys: np.ndarray, prints: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: spanning links among verified pairs of equal key that are not both probes."""
    n, pairs = len(keys), []
    live = np.arange(n)
    step = 1
    found, linked = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    while True:
        live = live[live + step < n]
        live = live[keys[live] == keys[live + step]]
        if not len(live):
            break
        good = live[~(probe[live] & probe[live + step]) & (np.bitwise_count(prints[live] ^ prints[live + step]) <= distance)]
        if len(good):
            pairs.append((good, good + step))
            found += len(good)
        if found > 1 << 20:
            linked, pairs, found = _spanning(n, linked, pairs), [], 0
        step += 1
    return _spanning(n, linked, pairs)


def _spanning(n: int, linked: tuple, pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([linked[i], *(p[i] for p in pairs)]) for i in (0, 1))
    if not len(a):
        return a, b
    root = _roots(n, a, b)
    away = np.flatnonzero(root != np.arange(n))
    return away, root[away]


def links(prints: DataFrame, distance: int = 4, block: int = BLOCK, kinds: int = 1) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span every component at `distance` bits.

    With `kinds`, the table has that many kinds of fingerprints of each text, told by the column kind (from
    0), and only prints of one kind are linked.

    Buckets are read in sorted runs; all their pairs are verified but only links that span what a run has linked
    leave the task, at most one per member, and none twice. A bucket of more than `block` rows is dealt out in blocks, each
    two of which meet in one task, so no task holds more than two blocks of a bucket at once.
    """
    n, both = bit_statistics(prints)
    plan = plan_search(n // kinds, both / kinds, distance)
    rows = signatures(prints, plan)
    large = rows.groupBy("part", "value").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    large = materialize(large, "large-buckets")
    if large.limit(1).count():
        marked = rows.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["part", "value"], "left")
        own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("_blocks")).cast("int")
        marked = marked.withColumn("_own", F.when(F.col("_blocks").isNull(), 0).otherwise(own)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        rows = marked.select("part", "value", "fingerprint", "probe", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"))
    else:
        rows = rows.withColumns({"low": F.lit(0), "high": F.lit(0)})
    keys = ["part", "value", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(final: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(c).to_numpy() for c in keys]
            change = np.ones(len(table), bool)
            if len(table):
                change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            # The last bucket may go on in the next batch.
            stop = len(table) if final or not len(table) else int(np.flatnonzero(change)[-1])
            key = np.cumsum(change)[:stop]
            values = table.column("fingerprint").to_numpy()[:stop]
            a, b = _verified(key, values.view(np.uint64), table.column("probe").to_numpy(zero_copy_only=False)[:stop].astype(bool), distance)
            held[:] = table.slice(stop).to_batches()
            pairs = np.unique(np.stack([values[a], values[b]], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            # A group meets again in every part: of all its buckets here one link per member stays, to its least print.
            names, place = np.unique(pairs, return_inverse=True)
            place = place.reshape(-1, 2)
            away, root = _spanning(len(names), (place[:0, 0], place[:0, 1]), [(place[:, 0], place[:, 1])])
            pairs = np.stack([names[away], names[root]], 1) if len(away) else pairs[:0]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 200_000:
                yield work(False)
        if held:
            yield work(True)
        held.clear()
        give_back()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long").distinct()


def classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fingerprint, component_id) from rows (doc_id, fingerprint): the least doc_id of all reachable documents."""
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connect(links(distinct, distance))
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, text_key of every document.

    Documents whose fingerprints differ in at most `distance` bits are linked; a component is named
    by its least doc_id. Texts without a word have fingerprint zero and are linked like any other.
    Copies meet by equal fingerprint before any search, so a group of copies is one print.

    Null text has no word. Null ids stay, and count for a component's name only if it has no other
    (its name is then null). Repeated rows give their row each. An empty table gives no rows; other
    columns are not looked at.
    """
    prints = materialize(fingerprints(docs, size, seed), "prints")
    named = classes(prints, distance)
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select("doc_id", shown.alias("fingerprint"), "component_id", "text_key")


def deduplicate(docs: DataFrame, distance: int = 4, size: int = 4) -> DataFrame:
    """The documents, one per component: that of the least doc_id (nulls last), all its columns kept.

    What goes is taken out by doc_id and a hash of the text. The rows that go are told to all executors
    if they have been counted to be few; texts move only beyond that, or to drop repeated rows.
    """
    found = materialize(near_duplicates(docs, distance, size), "components")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    # Components of null ids alone are told apart by their fingerprints.
    rows = found.withColumn("alone", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    first = rows.groupBy("component_id", "alone").agg(F.min(order).alias("o"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("component_id").alias("_c"), F.col("alone").alias("_a"), F.col("o.b").alias("_id"), F.col("o.c").alias("_key"))
    same = F.col("component_id").eqNullSafe(F.col("_c")) & F.col("alone").eqNullSafe(F.col("_a"))
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    gone = materialize(rows.join(first, same).filter(~stays).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_key"]), "left_anti")
    repeated = found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
