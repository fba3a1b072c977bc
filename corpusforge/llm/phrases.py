"""Phrase mining: counts of all frequent phrases from FM-indexes per shard, scored as collocations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusforge.llm.arrays import Words, fold_table, mix, prefix_hash, slices, span_hash, text_bytes
from corpusforge.llm.fm_index import DEPTH, WordIndex
from corpusforge.session import discard, materialize, shared_dir

#: Words of a shard, at most (one text may exceed it).
SHARD_WORDS = 3_000_000
LONGEST = DEPTH + 1
#: Occurrences of a phrase behind which first words are put in one part.
SPREAD = 1 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
#: Words end at spaces, tabs and breaks. NUL is a letter like any other: it takes a byte that UTF-8 never uses.
_TABLE = fold_table(" \t.,;:!?\n\v\f\r")
_TABLE[0] = 0xFF
_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


class _Shard:
    """Words of one language gathered within a task."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[int, bytes] = {}
        self.size = 0

    def add(self, texts: pa.Array) -> None:
        raw, offsets = text_bytes(texts)
        words = Words(raw, offsets, _TABLE)
        if not len(words.start):
            return
        hashes = span_hash(prefix_hash(words.folded), words.start, words.end)
        # A break lies before a word if a breaking character or the start of a text does.
        seen = np.append(0, np.cumsum(_BREAKS[raw]))
        breaks = np.append(True, seen[words.start[1:]] != seen[words.end[:-1]])
        breaks[words.first[:-1][words.first[:-1] < len(breaks)]] = True
        unique, first = np.unique(hashes, return_index=True)
        data = words.folded.tobytes()
        for h, a, b in zip(unique.tolist(), words.start[first].tolist(), words.end[first].tolist()):
            if h not in self.words:
                self.words[h] = data[a:b]
        self.runs.append((hashes, breaks))
        self.size += len(hashes)

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        """Ids count from 1 in the order of `words`; 0 is a break."""
        hashes, breaks = (np.concatenate([r[i] for r in self.runs]) for i in (0, 1))
        unique, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        ids = np.insert(which.astype(np.int32) + 1, np.flatnonzero(breaks), 0)
        words = [self.words[h].replace(b"\xff", b"\0").decode("utf-8", "replace") for h in unique.tolist()]
        blob = zstandard.ZstdCompressor(level=1).compress(ids.astype("<i4").tobytes())
        return pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "total": self.size, "words": words, "counts": counts.tolist(), "ids": blob}], schema=_SHARDS)


def word_shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Texts as word ids, one row per shard: shard, lang, total, words, counts, ids. A task keeps one open shard per language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, {}
        for batch in slices(batches):
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                shard = open_.setdefault(lang, _Shard())
                shard.add(batch.column("text").filter(pa.compute.equal(langs, lang)))
                if shard.size >= shard_words:
                    yield open_.pop(lang).row(number, lang)
                    number += 1
        for lang, shard in open_.items():
            if shard.size:
                yield shard.row(number, lang)
                number += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "shard long, lang string, total long, words array<string>, counts array<long>, ids binary")


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of integers as one compressed block, the lowest bytes of all values first, so that empty high bytes cost nothing."""
    raw = b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    sizes = np.array([len(columns), *map(len, columns)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + raw)


def _columns(block: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    sizes = raw[8 : 8 + 8 * int(raw[:8].view("<i8")[0])].view("<i8")
    at, out = 8 + 8 * len(sizes), []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * n
    return out


def _blocks(rows: pa.Array) -> list[np.ndarray]:
    """Columns of all blocks of one list, joined."""
    return [np.concatenate(c) for c in zip(*(_columns(b) for b in rows.to_pylist()))]


_VOCABULARY = pa.schema([("shard", pa.int64()), ("block", pa.binary()), ("word_id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
_TASK_BITS = 16


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the words of rows sorted by language and word: a row per word, and a block per shard of its ids, word ids and counts."""
    task, group, last = TaskContext.get().partitionId(), -1, None
    if task >> _TASK_BITS:
        raise ValueError(f"more than {1 << _TASK_BITS} partitions")
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        shard, ids, names, f = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(shard, kind="stable")
        shards, first = np.unique(shard[order], return_index=True)
        blocks = [_planes(*(c[part] for c in (ids, names, f))) for part in np.split(order, first[1:])]
        none = pa.nulls(len(shards))
        return pa.RecordBatch.from_arrays([pa.array(shards), pa.array(blocks, pa.binary()), *(none.cast(t.type) for t in list(_VOCABULARY)[2:])], schema=_VOCABULARY)

    for batch in batches:
        if not len(batch):
            continue
        lang, word = batch.column("lang"), batch.column("word")
        same = pa.compute.and_(pa.compute.equal(lang[1:], lang[:-1]), pa.compute.equal(word[1:], word[:-1])).to_numpy(zero_copy_only=False)
        new = np.append((lang[0].as_py(), word[0].as_py()) != last, ~same)
        number = group + np.cumsum(new)
        group, last = int(number[-1]), (lang[-1].as_py(), word[-1].as_py())
        names = (number << _TASK_BITS) + task
        held.append((batch.column("shard").to_numpy(), batch.column("id").to_numpy().astype(np.int64), names, batch.column("f").to_numpy()))
        at = pa.array(np.flatnonzero(new))
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(names[new]), lang.take(at), word.take(at), batch.column("f").take(at)], schema=_VOCABULARY)
        if sum(len(h[0]) for h in held) >= 1 << 18:
            yield flush()
    if held:
        yield flush()


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index each shard over its frequent words alone; other words part phrases as breaks do."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(len(batch)):
            local, names, f = _blocks(batch.column("known").slice(i, 1).flatten())
            order = np.argsort(names)
            ids = np.frombuffer(tool.decompress(batch.column("ids")[i].as_py()), "<i4")
            small = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
            small[local[order]] = np.arange(1, len(local) + 1)
            blocks = [_planes(names[order], f[order]), *WordIndex.of(small[ids], len(local) + 1).to_bytes()]
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), *(pa.array([b], pa.binary()) for b in blocks)], names=["shard", "names", "before", "behind"])


def _grow(length: int, parts: int, spread: int):
    """Task function: from indexes (and the frequent phrases of `length` words) to their phrases of one word more, one block per shard and part.

    A phrase belongs to the part that its words behind the first and, where those are very frequent, a piece
    of the range of first words decide.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                names, f = _columns(batch.column("names")[i].as_py())
                index = WordIndex.from_bytes(batch.column("before")[i].as_py(), batch.column("behind")[i].as_py(), len(names) + 1)
                if length == 1:
                    ids, phrases = index.words()
                    behind, total = [names[ids - 1]], f[ids - 1]
                    owner, word, found = index.extend(phrases, True)
                else:
                    *behind, total = _blocks(batch.column("held").slice(i, 1).flatten())
                    phrases = index.find(np.stack([np.searchsorted(names, w) + 1 for w in behind], 1))
                    owner, word, found = index.longer(phrases)
                if not len(owner):
                    continue
                first = names[word - 1]
                key = (first % -(-total // spread)[owner]).astype(np.uint64)
                for w in behind:
                    key = mix(key ^ w[owner].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                part = (mix(key) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                number, cut = np.unique(part[order], return_index=True)
                columns = [first, *(w[owner] for w in behind), found.n]
                shard = batch.column("shard")[i].as_py()
                blocks = [_planes(*(c[rows] for c in columns)) for rows in np.split(order, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array([shard] * len(number), pa.int64()), pa.array(blocks, pa.binary())], names=["part", "shard", "block"])

    return grow


def _merge(length: int, least: int):
    """Task function: sum the phrases of each part over its shards; a row per frequent phrase, and per shard a block of those it has."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.binary()), ("words", pa.list_(pa.int64())), ("f", pa.int64())])

    def rows_of(shards: list[int], blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_columns(b) for b in blocks]
        *words, n = (np.concatenate(c) for c in zip(*parts))
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort(words)
        words, n, owner = [w[order] for w in words], n[order], owner[order]
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([w[1:] != w[:-1] for w in words])))
        total = np.add.reduceat(n, first)
        kept = total >= least
        if not kept.any():
            return
        names = np.stack([w[first[kept]] for w in words], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * length), pa.array(names.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.binary()), lists, pa.array(total[kept])], schema=schema)
        f = np.repeat(total, np.diff(first, append=len(n)))
        row = np.flatnonzero(f >= least)
        row = row[np.argsort(owner[row], kind="stable")]
        own, cut = np.unique(owner[row], return_index=True)
        found = [_planes(*(w[rows] for w in words), f[rows]) for rows in np.split(row, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([shards[o] for o in own], pa.int64()), pa.array(found, pa.binary()), pa.nulls(len(own), pa.list_(pa.int64())), pa.nulls(len(own), pa.int64())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shards, blocks = None, [], []
        for batch in batches:
            for part, shard, block in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "block"))):
                if part != now and blocks:
                    yield from rows_of(shards, blocks)
                    shards, blocks = [], []
                now = part
                shards.append(shard)
                blocks.append(block)
        if blocks:
            yield from rows_of(shards, blocks)

    return merge


def count_phrases(docs: DataFrame, least: int = 100, shard_words: int = SHARD_WORDS, spread: int = SPREAD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to 5 words that occur at least `least` times in their language.

    `docs` needs text and lang. Returns three written tables: words (word_id, lang, word, f), phrases
    (words: array of word ids, f) of 2 words and more, and totals (lang, n).

    Words are counted first. Each shard then gets a bidirectional FM-index over its frequent words, written
    once and dealt by shard. A phrase can only be frequent if its beginning and its end, one word
    shorter, are; so each round takes the frequent phrases of one length back to the shards that have
    them, finds their intervals by backward search, lists the extensions seen from both sides, and sums
    them across shards. What moves are blocks of phrases, one per shard and part, never an index. There
    are as many parts as shards, so a part holds about as many phrases as a shard whatever the
    size of the corpus; phrases behind a very frequent word or phrase spread over many parts.
    Words are told apart by 64-bit hashes within a shard.

    Null text has no words; a null lang is `und`; repeated rows count as often as they come; other columns
    are not looked at; empty tables give empty tables.
    """
    spark = docs.sparkSession
    shards = materialize(word_shards(docs, shard_words), "word-shards")
    totals = materialize(shards.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("shard", "lang", (F.col("pos") + 1).alias("id"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    single = local.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("f") >= least)
    vocabulary = materialize(single.select("shard", "id", "lang", "word", "f").mapInArrow(_number, "shard long, block binary, word_id long, lang string, word string, f long"), "vocabulary")
    words = vocabulary.filter("word_id IS NOT NULL").select("word_id", "lang", "word", "f")
    known = vocabulary.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("block").alias("known"))
    made = shards.select("shard", "ids").join(known, "shard").mapInArrow(_indexes, "shard long, names binary, before binary, behind binary")
    name, parts = f"phrase_index_{uuid.uuid4().hex}", max(1, shards.count())
    made.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").bucketBy(min(20_000, parts), "shard").saveAsTable(name)
    index = spark.table(name)
    levels: list[DataFrame] = []
    for length in range(1, LONGEST):
        source = index
        if length > 1:
            held = levels[-1].filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("block").alias("held"))
            source = index.join(held, "shard")
        found = source.mapInArrow(_grow(length, parts, spread), "part long, shard long, block binary")
        summed = found.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(length + 1, least), "shard long, block binary, words array<long>, f long")
        levels.append(materialize(summed, f"phrases-{length + 1}"))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.union(level)
    phrases = materialize(phrases.filter("words IS NOT NULL").select("words", "f"), "phrases")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    spark.sql(f"DROP TABLE {name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    discard(shards, *levels)
    return words, phrases, totals


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact for counts up to 10**17."""
    wide = [x.cast("decimal(18,0)") for x in (a, n, left, right)]
    return F.floor(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide[0] * wide[1]).cast("decimal(34,0)"), wide[2] * wide[3])).cast("long")


def collocations(words: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Score phrases and drop those that only occur inside longer ones: lang, words, a, l, r, n, score.

    A phrase cut after its first k words has l = f(first part) and r = f(rest); its score is that of the worst
    cut, the smallest k of equal ones. A phrase goes if a longer frequent one that contains it is as
    frequent; as counts can only fall from a phrase to a longer one, it is enough to look at those with one word more in
    front or behind.
    """
    langs = words.select(F.col("word_id").alias("first"), "lang")
    counts = phrases.select("words", "f").union(words.select(F.array("word_id").alias("words"), "f"))
    longer = phrases.filter(F.size("words") > 2)
    inner = longer.select("f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    covered = inner.groupBy("words").agg(F.max("f").alias("most"))
    left = phrases.join(covered, "words", "left").filter("most IS NULL OR most < f").select("words", F.col("f").alias("a"))
    left = left.withColumn("first", F.element_at("words", 1)).join(langs, "first").drop("first")
    cuts = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(words, 1, k)")).withColumn("rest", F.expr("slice(words, k + 1, size(words) - k)"))
    cuts = cuts.join(counts.select(F.col("words").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
    scored = cuts.join(totals, "lang").select("lang", "words", "a", "n", F.struct(cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    worst = scored.groupBy("lang", "words", "a", "n").agg(F.min("cut").alias("cut"))
    return worst.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """`phrases` with the column phrase: its words joined by spaces."""
    out = phrases
    for i in range(LONGEST):
        names = words.select(F.col("word_id").alias("_id"), F.col("word").alias(f"_word{i}"))
        out = out.join(names, F.get("words", F.lit(i)) == F.col("_id"), "left").drop("_id")
    parts = [f"_word{i}" for i in range(LONGEST)]
    return out.withColumn("phrase", F.concat_ws(" ", *parts)).drop(*parts)


def top_collocations(docs: DataFrame, least: int = 100, top: int = 2000, shard_words: int = SHARD_WORDS, spread: int = SPREAD) -> DataFrame:
    """The first `top` collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Ordered by score and a, both falling, then phrase in UTF-8 byte order. See `count_phrases` for odd input.
    """
    words, phrases, totals = count_phrases(docs, least, shard_words, spread)
    scored = spelled(collocations(words, phrases, totals), words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    found = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, phrases, totals)
    return found
