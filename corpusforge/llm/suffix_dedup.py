"""Removal of repeated passages by a distributed, prefix-aware merge of sorted suffixes.

Of all suffixes only those at anchors are sorted. An anchor is a place the text chooses by its own bytes
(`repeats.anchors`): equal strings of `length` bytes have their anchors at equal distances, and agree
at least in the length - length // 2 + 1 bytes from the anchor on. So:

1. Anchors of all texts; their suffixes' hashes are counted, and anchors whose hash is alone go.
2. Each task sorts the other suffixes (cut to those bytes), joins equal ones, and sends its run
   front-coded, in pieces by range. A loser tree merges the runs of a range and finds, from the common
   prefixes it carries, the suffixes that stand at two places or more.
3. The stretch around an anchor that its strings cover is known by a 128-bit hash: a stretch that
   stands twice is repeated as a whole. Where stretches around equal suffixes differ, each of their
   strings is compared, by 96-bit hashes, across one copy of each stretch.

Hashes of step 1 only choose what to sort; those of step 3 decide.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import mix, prefix_hash, ragged, slices, span_hash, text_bytes
from corpusforge.llm.lcp_merge import decode_run, encode_run, merge_runs
from corpusforge.llm.repeats import anchors
from corpusforge.llm.tokens import forget
from corpusforge.session import discard, materialize

ROW, SPANS, LEFT = "_repeats_row", "_repeats_spans", "_repeats_left"
# Rows of three numbers at most: under 100 MB in memory.
BROADCAST_ROWS = 1_000_000
# Suffixes merged, strings compared, and stretches around one suffix put into one bucket at a time, about.
RANGE_ROWS, BUCKET_ROWS, SEED_ROWS = 500_000, 4_000_000, 20_000
_SECOND = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _known(table: DataFrame) -> DataFrame:
    """The table, told to all executors if it has been counted to be small; else the join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _code(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of an anchor in its text, and how far before it its strings start, in one number."""
    return (place << 24) | ((place - first) << 12) | (place - last)


def _parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = code >> 24
    return place, place - ((code >> 12) & 4095), place - (code & 4095)


class Finder:
    """The steps above over a staged, bucketed table of rows with their texts."""

    def __init__(self, docs: DataFrame, length: int):
        if not 64 <= length <= 4000:
            raise ValueError("length must be between 64 and 4000 bytes")
        self.spark, self.length = docs.sparkSession, length
        self.suffix = length - length // 2 + 1
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table, self.kept = f"repeats_{uuid.uuid4().hex}", []
        rows = docs.withColumn(ROW, F.monotonically_increasing_id()).repartition(self.tasks, ROW)
        # Bucketed by row, so that no later step shuffles a text again.
        rows.write.bucketBy(self.tasks, ROW).format("parquet").option("compression", "zstd").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _texts(self) -> DataFrame:
        return self.rows().select(ROW, F.col("text").cast("string").alias("text"))

    def drop(self) -> None:
        """Delete the staged texts and spans; nothing may read them any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(*self.kept)

    def anchors(self) -> DataFrame:
        """(row, code, seed, head) of all anchors; head is the suffix's first 8 bytes, as an ordered number."""
        length, suffix = self.length, self.suffix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in slices(batches):
                raw, offsets = text_bytes(batch.column("text"))
                text, place, first, last = anchors(raw, offsets, length)
                seed = span_hash(prefix_hash(raw), place, place + suffix)
                head = np.zeros(len(place), np.uint64)
                for i in range(8):
                    head = (head << np.uint64(8)) | raw[place + i].astype(np.uint64)
                rows = batch.column(ROW).to_numpy()[text]
                base = offsets[text]
                columns = [rows, _code(place - base, first - base, last - base), seed.view(np.int64), (head ^ np.uint64(1 << 63)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[ROW, "code", "seed", "head"])

        return self._texts().mapInArrow(run, f"{ROW} long, code long, seed long, head long")

    def survivors(self) -> tuple[DataFrame, list[int]]:
        """Anchors whose suffix hash stands at two places or more, and heads that part all anchors evenly."""
        found = materialize(self.anchors(), "anchors")
        kept = self._repeated(found)
        ranges = max(self.tasks, -(-kept.count() // RANGE_ROWS))
        points = [i / ranges for i in range(1, ranges)]
        cuts = found.agg(F.percentile_approx("head", points, 10_000).alias("p")).first()["p"] if points else []
        discard(found)
        return kept, sorted(set(cuts or []))

    def _repeated(self, found: DataFrame) -> DataFrame:
        twice = materialize(found.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "seeds")
        kept = materialize(found.select(ROW, "code", "seed").join(_known(twice), "seed", "left_semi").select(ROW, "code"), "survivors")
        discard(twice)
        return kept

    def surroundings(self, longer: int) -> DataFrame:
        """Where repeated strings can be: the strings of anchors whose suffix hash stands twice, in runs.

        A row per text with any (_origin, n_repeated: their bytes, n_repeated_spans: their runs), and a row per run of `longer`
        bytes or more (_origin, _start, text). Every repeated string of `longer` bytes lies in such a run, as
        all strings within it are repeated too.
        """
        length = self.length
        found = materialize(self.anchors().select(ROW, "code", "seed"), "anchors")
        kept = self._repeated(found)
        discard(found)
        self.kept.append(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = []
                for row, text, codes in zip(batch.column(ROW).to_pylist(), batch.column("text"), batch.column("codes")):
                    data = text.as_py().encode()
                    _, first, last = _parts(np.sort(codes.values.to_numpy()))
                    first, stop = np.sort(first), np.sort(last) + length
                    opens = np.append(True, first[1:] > np.maximum.accumulate(stop)[:-1])
                    starts, stops = first[opens], np.append(stop[np.flatnonzero(opens)[1:] - 1], stop[-1])
                    out.append((row, None, int((stops - starts).sum()), len(starts), None))
                    for start, stop in zip(starts.tolist(), stops.tolist()):
                        if stop - start >= longer:
                            # Whole characters: up to three bytes more at either end, too few for another string.
                            while start and data[start] & 0xC0 == 0x80:
                                start -= 1
                            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                                stop += 1
                            out.append((row, start, None, None, data[start:stop].decode()))
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_origin", "_start", "n_repeated", "n_repeated_spans", "text"])

        return self._with_texts(kept).mapInArrow(run, "_origin long, _start long, n_repeated long, n_repeated_spans long, text string")

    def _with_texts(self, kept: DataFrame, codes: str = "code") -> DataFrame:
        """Texts with the anchors wanted in them; only the anchors move."""
        grouped = kept.groupBy(ROW).agg(F.collect_list(codes).alias("codes"))
        return self._texts().join(grouped, ROW)

    def stretches(self, kept: DataFrame, cuts: list[int]) -> DataFrame:
        """Two kinds of rows: (range, run) pieces of sorted runs, and (seed, a, b, row, code), the stretch of each anchor."""
        suffix, length = self.suffix, self.length
        edges = np.array(cuts, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: dict[bytes, list] = {}

            def flush() -> pa.RecordBatch:
                strings = sorted(groups)
                heads = np.frombuffer(b"".join(s[:8] for s in strings), ">u8").astype(np.uint64) if strings else np.zeros(0, np.uint64)
                ranges = np.searchsorted(edges, (heads ^ np.uint64(1 << 63)).view(np.int64), "right")
                tool, out = zstandard.ZstdCompressor(level=1), []
                for part in np.unique(ranges):
                    some = strings[np.searchsorted(ranges, part) : np.searchsorted(ranges, part, "right")]
                    prefixes, tails = encode_run(some)
                    about = np.array([groups[s] for s in some], np.uint64)
                    out.append((int(part), tool.compress(np.uint32(len(some)).tobytes() + about.tobytes() + prefixes.tobytes() + tails)))
                groups.clear()
                n = len(out)
                empty = pa.nulls(n, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), *[empty] * 5], names=["range", "run", "seed", "a", "b", ROW, "code"])

            held = 0
            for batch in slices(batches):
                raw, offsets = text_bytes(batch.column("text"))
                codes = batch.column("codes")
                code = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(codes).to_numpy(zero_copy_only=False))
                place, first, last = (x + offsets[text] for x in _parts(code))
                one, two = prefix_hash(raw), prefix_hash(raw, _SECOND)
                seed = span_hash(one, place, place + suffix)
                a, b = span_hash(one, first, last + length), span_hash(two, first, last + length)
                data = raw.tobytes()
                for at, *about in zip(place.tolist(), seed.tolist(), a.tolist(), b.tolist()):
                    s = data[at : at + suffix]
                    got = groups.get(s)
                    if got is None:
                        groups[s] = [about[0], 1, about[1], about[2], 0]
                        held += 1
                    else:
                        got[1] += 1
                        got[4] |= got[2:4] != about[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(code), pa.int32()), pa.nulls(len(code), pa.binary()), *(pa.array(x.view(np.int64)) for x in (seed, a, b)), pa.array(batch.column(ROW).to_numpy()[text]), pa.array(code)],
                    names=["range", "run", "seed", "a", "b", ROW, "code"],
                )
                if held > 200_000:
                    yield flush()
                    held = 0
            yield flush()

        schema = f"range int, run binary, seed long, a long, b long, {ROW} long, code long"
        return materialize(self._with_texts(kept).mapInArrow(run, schema), "stretches")

    def verdicts(self, stretches: DataFrame) -> DataFrame:
        """(seed, mixed) of suffixes at two places or more; mixed if the stretches around them differ."""
        suffix = self.suffix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool, held, now = zstandard.ZstdDecompressor(), [], None

            def merged() -> pa.RecordBatch:
                abouts, streams = [], []
                for blob in held:
                    data = tool.decompress(blob)
                    n = int(np.frombuffer(data, np.uint32, 1)[0])
                    abouts.append(iter(np.frombuffer(data, np.uint64, 5 * n, 4).reshape(n, 5).tolist()))
                    prefixes = np.frombuffer(data, np.uint16, n, 4 + 40 * n)
                    streams.append(decode_run(prefixes, data[4 + 42 * n :], suffix))
                held.clear()
                seeds, flags, last = [], [], None
                for which, _, prefix in merge_runs(streams):
                    seed, n, a, b, mixed = next(abouts[which])
                    if last is not None and prefix == suffix:
                        last[1] += n
                        last[4] |= mixed or (last[2], last[3]) != (a, b)
                        continue
                    if last is not None and last[1] > 1:
                        seeds.append(last[0])
                        flags.append(bool(last[4]))
                    last = [seed, n, a, b, mixed]
                if last is not None and last[1] > 1:
                    seeds.append(last[0])
                    flags.append(bool(last[4]))
                return pa.RecordBatch.from_arrays([pa.array(np.array(seeds, np.uint64).view(np.int64)), pa.array(flags, pa.bool_())], names=["seed", "mixed"])

            for batch in batches:
                for part, blob in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist()):
                    if part != now and held:
                        yield merged()
                    now = part
                    held.append(blob)
            if held:
                yield merged()

        runs = stretches.filter("run IS NOT NULL").select("range", "run").repartition(self.tasks, "range").sortWithinPartitions("range")
        return runs.mapInArrow(run, "seed long, mixed boolean").groupBy("seed").agg(F.bool_or("mixed").alias("mixed"), F.count("*").alias("classes"))

    def strings(self, chosen: DataFrame) -> DataFrame:
        """(bucket, hashed, block): the strings of the chosen anchors.

        Strings equal within a slice are settled there: their spans go out as they are, and one of them,
        marked as repeated, stands for them among the hashed ones.
        """
        length, suffix = self.length, self.suffix
        code = F.col("code")
        strings = chosen.agg(F.sum(F.shiftright(code, 12).bitwiseAND(4095) - code.bitwiseAND(4095) + 1)).first()[0] or 0
        buckets = max(self.tasks, -(-strings // BUCKET_ROWS))
        # The strings around a suffix in very many stretches are dealt out by slices of their own hashes.
        hot = chosen.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > SEED_ROWS)
        sliced = chosen.join(hot, "seed", "left").select(ROW, F.struct("code", F.coalesce(F.ceil(F.col("n") / SEED_ROWS), F.lit(1)).cast("long").alias("slices")).alias("code"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = zstandard.ZstdCompressor(level=1)
            for batch in slices(batches, most=2 << 20):
                raw, offsets = text_bytes(batch.column("text"))
                codes = batch.column("codes")
                code, slices_ = (codes.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                text = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(codes).to_numpy(zero_copy_only=False))
                anchor, first, last = _parts(code)
                counts = last - first + 1
                place, owner = ragged(first + offsets[text], counts), np.repeat(text, counts)
                prefix = prefix_hash(raw)
                seed = span_hash(prefix, anchor + offsets[text], anchor + offsets[text] + suffix)
                # Equal strings share their suffix and the distance to it; a frequent suffix is dealt out by distance.
                near = (np.repeat(anchor + offsets[text], counts) - place) >> 4
                a = span_hash(prefix, place, place + length)
                piece = mix(a % np.repeat(slices_, counts).astype(np.uint64))
                bucket = (mix(np.repeat(seed, counts) + near.astype(np.uint64) + piece) % np.uint64(buckets)).astype(np.int64)
                b = span_hash(prefix_hash(raw, _SECOND), place, place + length) & np.uint64(0xFFFFFFFF)
                row = batch.column(ROW).to_numpy()[owner]
                where = place - offsets[owner]
                order = np.lexsort((b, a))
                a, b, row, where, bucket = a[order], b[order], row[order], where[order], bucket[order]
                head = np.ones(len(a), bool)
                head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                settled = ~head | np.append(~head[1:], False)
                out = []
                if settled.any():
                    found = _spans(row[settled], where[settled], length)
                    out.append((int(row[0] % buckets), False, tool.compress(b"".join(found.column(c).to_numpy().tobytes() for c in range(3)))))
                go = np.flatnonzero(head)
                order = np.argsort(bucket[go], kind="stable")
                go = go[order]
                bucket = bucket[go]
                for part in np.unique(bucket):
                    some = go[np.searchsorted(bucket, part) : np.searchsorted(bucket, part, "right")]
                    out.append((int(part), True, _block(tool, a[some], b[some], row[some], where[some], settled[some])))
                columns = list(zip(*out)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "hashed", "block"])

        return self._with_texts(sliced).mapInArrow(run, "bucket int, hashed boolean, block binary")

    def matched(self, strings: DataFrame) -> DataFrame:
        """(row, start, stop) of strings that stand at two places, neighbouring ones joined."""
        length = self.length

        def met(blocks: list[tuple]) -> pa.RecordBatch:
            a, b, row, where, twice = (np.concatenate(c) for c in zip(*blocks))
            order = np.lexsort((b, a))
            a, b, row, where, twice = a[order], b[order], row[order], where[order], twice[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            hit = ~head | np.append(~head[1:], False) | twice
            return _spans(row[hit], where[hit], length)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, now = [], None
            for batch in batches:
                for bucket, hashed, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashed", "block"))):
                    if bucket != now and blocks:
                        yield met(blocks)
                        blocks = []
                    now = bucket
                    if hashed:
                        blocks.append(_unblock(blob))
                    else:
                        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(3, -1)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=[ROW, "start", "stop"])
            if blocks:
                yield met(blocks)

        dealt = strings.repartition(self.tasks, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(meet, f"{ROW} long, start long, stop long")

    def whole(self, stretches: DataFrame, groups: DataFrame) -> DataFrame:
        """(row, start, stop) of the stretches that stand at two places."""
        code, keys = F.col("code"), ["a", "b"]
        place = F.shiftright(code, 24)
        again = _known(groups.filter("n > 1").select(*keys))
        return (
            stretches.filter("run IS NULL")
            .join(again, keys, "left_semi")
            .select(ROW, (place - F.shiftright(code, 12).bitwiseAND(4095)).alias("start"), (place - code.bitwiseAND(4095) + self.length).alias("stop"))
        )

    def groups(self, stretches: DataFrame) -> DataFrame:
        """One row per distinct stretch around a suffix that stands at two places: its count, one of its anchors, the verdict."""
        verdicts = materialize(self.verdicts(stretches), "verdicts")
        own = stretches.filter("run IS NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(ROW, "code", "seed")).alias("one"))
        groups = own.withColumn("seed", F.col("one.seed")).join(_known(verdicts), "seed")
        groups = materialize(groups.select("a", "b", "n", "seed", f"one.{ROW}", "one.code", (F.col("mixed") | (F.col("classes") > 1)).alias("mixed")), "groups")
        discard(verdicts)
        return groups

    def spans(self) -> DataFrame:
        """(row, start, stop) in bytes; together they cover exactly the repeated strings."""
        kept, cuts = self.survivors()
        stretches = self.stretches(kept, cuts)
        discard(kept)
        groups = self.groups(stretches)
        whole = materialize(self.whole(stretches, groups), "whole")
        discard(stretches)
        matched = materialize(self.matched(self.strings(groups.filter("mixed").select(ROW, "code", "seed"))), "matched")
        discard(groups)
        self.kept += [whole, matched]
        return whole.union(matched)


def _block(tool, a, b, row, where, twice) -> bytes:
    order = np.lexsort((where, row))
    a, b, row, where, twice = (x[order] for x in (a, b, row, where, twice))
    steps = np.diff(row, prepend=0).astype(np.int64), np.diff(where, prepend=0).astype(np.int64)
    return np.uint32(len(a)).tobytes() + a.tobytes() + b.astype(np.uint32).tobytes() + tool.compress(b"".join(x.tobytes() for x in (*steps, twice.astype(np.uint8))))


def _unblock(blob: bytes) -> tuple:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    a, b = np.frombuffer(blob[4 : 4 + 8 * n], np.uint64), np.frombuffer(blob[4 + 8 * n : 4 + 12 * n], np.uint32)
    rest = zstandard.ZstdDecompressor().decompress(blob[4 + 12 * n :])
    row, where = (np.cumsum(np.frombuffer(rest, np.int64, n, 8 * n * i)) for i in (0, 1))
    return a, b, row, where, np.frombuffer(rest, np.uint8, n, 16 * n).astype(bool)


def _spans(row: np.ndarray, where: np.ndarray, length: int) -> pa.RecordBatch:
    """Neighbouring starts of one row become one span."""
    order = np.lexsort((where, row))
    row, where = row[order], where[order]
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (where[1:] - where[:-1] > length)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(where[first]), pa.array(where[last] + length)], names=[ROW, "start", "stop"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def _grouped(spans: DataFrame) -> DataFrame:
    return spans.groupBy(ROW).agg(F.collect_list(F.struct("start", "stop")).alias(SPANS))


def remove_repeats(docs: DataFrame, length: int = 400, figures: bool = True, shorter: int | None = None) -> DataFrame:
    """Take away every byte covered by a `length`-byte string that also starts anywhere else.

    Texts are judged as UTF-8 bytes, on the input; strings do not cross documents, overlaps count. With
    `figures`, one row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256. Without, the documents with all their columns, `text` being what is left (a
    character cut in half goes; null stays null) and n_chars, if there, its length.

    With `shorter`, a length below `length`, figures also tell of repeats of that length (n_repeated bytes in
    n_repeated_spans runs); nothing more is taken away for them. They count all bytes of strings of `shorter` bytes that
    stand twice, and of those around the same anchor where only the anchor's own half (shorter - shorter // 2 + 1 bytes)
    does. Every repeated string of `length` bytes lies in such a run, so only those runs are searched at `length`.

    A suffix in a third of all documents is one string of each sorted run, a repeated stretch one row of
    partial counts, and of equal strings one per slice moves on. Null text has no bytes. Repeated
    rows are copies. Null ids stay. An empty table gives no rows. Staged tables are deleted before the
    result, itself a written table, is returned.
    """
    if shorter is not None and not (figures and shorter < length):
        raise ValueError("shorter goes with figures, and must be below length")
    finder = Finder(docs, shorter or length)
    rows, inner = finder.rows(), None
    if shorter is None:
        spans = _grouped(finder.spans())
    else:
        around = materialize(finder.surroundings(length), "surroundings")
        finder.kept.append(around)
        inner = Finder(around.filter("text IS NOT NULL").select("_origin", "_start", "text"), length)
        found = inner.spans().join(inner.rows().select(ROW, "_origin", "_start"), ROW)
        found = found.select(F.col("_origin").alias(ROW), (F.col("start") + F.col("_start")).alias("start"), (F.col("stop") + F.col("_start")).alias("stop"))
        spans = around.filter("text IS NULL").select(F.col("_origin").alias(ROW), "n_repeated", "n_repeated_spans").join(_grouped(found), ROW, "left")

    def figure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found, wide, times in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", SPANS, "n_repeated", "n_repeated_spans"))):
                data = (text or "").encode()
                runs = _union([(s["start"], s["stop"]) for s in found or []])
                digest, at = hashlib.sha256(), 0
                for start, stop in [*runs, (len(data), len(data))]:
                    digest.update(data[at:start])
                    at = stop
                out.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), wide or 0, times or 0))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_repeated_spans"])

    def cut(text, found):
        import pandas as pd

        kept = []
        for value, runs in zip(text, found):
            if value is None or runs is None:
                kept.append(value)
                continue
            data, at, out = value.encode(), 0, []
            for start, stop in [*_union([(s["start"], s["stop"]) for s in runs]), (len(data), len(data))]:
                out.append(data[at:start])
                at = stop
            kept.append(b"".join(out).decode("utf-8", "ignore"))
        return pd.Series(kept)

    if figures:
        wanted = rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, ROW, "left")
        if shorter is None:
            wanted = wanted.withColumns({"n_repeated": F.lit(0).cast("long"), "n_repeated_spans": F.lit(0).cast("long")})
        result = wanted.select("doc_id", "text", SPANS, "n_repeated", "n_repeated_spans").mapInArrow(figure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, n_repeated_spans long")
        if shorter is None:
            result = result.drop("n_repeated", "n_repeated_spans")
    else:
        left = F.pandas_udf(cut, "string")
        joined = rows.join(spans, ROW, "left")
        joined = joined.withColumn(LEFT, F.when(F.col(SPANS).isNotNull(), left(F.col("text").cast("string"), F.col(SPANS))).otherwise(F.col("text")))
        columns = [F.col(LEFT).alias("text") if c == "text" else F.when(F.col(SPANS).isNotNull(), F.length(LEFT)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
        result = joined.select(*columns)
    result = materialize(result, "repeats")
    finder.drop()
    if inner is not None:
        inner.drop()
    return result
