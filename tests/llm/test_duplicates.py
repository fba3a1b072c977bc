"""Near duplicates, repeated passages, benchmark items and license notices against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from odd_tables import ODD, PASSAGE, nothing, odd, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from corpusforge.llm import components, decontamination, lcp_merge, licenses, simhash, suffix_dedup
from corpusforge.llm.repeats import anchors, sliding_minimum


def fingerprint(text, size=4):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least_of_component(prints, distance):
    """Index to least doc_id (None if all are) over rows (doc_id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(prints))]


def near_rows():
    rng, rows = random.Random(5), []
    for g in range(8):
        words = prose(100 + g, 120).split()
        for k in range(10):
            own = list(words)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = rng.choice(["zig", "zag", "zog"])
            rows.append((1000 + 10 * g + k, " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = [r for r in ODD if len(r[1] or "") < 50_000] + near_rows()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_rows(spark, rows)).collect())
    prints = [(d, fingerprint(t)) for d, t in rows]
    want = sorted(((d is None, d or 0), f"{f:016x}", c) for (d, f), c in zip(prints, least_of_component(prints, 4)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("distance,block", [(4, 4), (4, 10_000), (2, 3), (7, 10_000)])
def test_links_lose_nothing(spark, distance, block):
    rng = random.Random(distance)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 2))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in components.connect(simhash.links(df, distance, block)).collect()}
    want = least_of_component(list(zip(signed, prints)), distance)
    assert [roots.get(s, s) for s in signed] == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (10, 500, 10**6, 10**10):
        plan = simhash.plan_search(n, bits.T @ bits * (n / 500), 4)
        parts = [t for _, t in plan]
        assert sum(t + 1 for t in parts) == 5 and sorted(b for g, _ in plan for b in g) == sorted(set(b for g, _ in plan for b in g))


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.deduplicate(nothing).collect() == []


def test_deduplicate_keeps_one_each(spark):
    rows = [r for r in ODD if len(r[1] or "") < 50_000] + near_rows()
    kept = simhash.deduplicate(odd_rows(spark, rows))
    assert kept.columns == odd_rows(spark, rows).columns
    prints = [(d, fingerprint(t)) for d, t in rows]
    least = least_of_component(prints, 4)
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted({repr(x) for x in least if x is not None}) + ["None"] * len({f for (_, f), c in zip(prints, least) if c is None})


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r["node"]: r["root"] for r in components.connect(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
    assert components.connect(spark.createDataFrame([], "u long, v long")).collect() == []


# --- repeated passages ------------------------------------------------------------------


def removed(texts, length):
    """For each text the kept bytes and the number of removed runs, by counting all strings."""
    counts = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        yield bytes(np.frombuffer(t, np.uint8)[~gone]), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())


@pytest.mark.parametrize("length", [64, 150])
def test_repeats(spark, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    rows = [(100 + i, "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("fghij") for _ in range(40)) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    rows += [r for r in ODD if len(r[1] or "") < 50_000] + [(900, "ab" * 200), (901, "z" * (length - 1)), (902, "q" * length), (903, "q" * (length + 1))]
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(odd_rows(spark, rows), length).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((repr(d), len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for (d, _), t, (k, n) in zip(rows, texts, removed(texts, length)))
    assert got == want


def test_repeats_cut_texts(spark, odd, nothing):
    rows = [(1, "é" * 40 + PASSAGE + "end"), (2, "start " + PASSAGE), (3, None), (4, "short")]
    df = odd_rows(spark, rows)
    cut = suffix_dedup.remove_repeats(df, 100, figures=False)
    assert cut.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert got == {1: ("é" * 40 + "end", 43), 2: ("start ", 6), 3: (None, None), 4: ("short", 5)}
    assert suffix_dedup.remove_repeats(nothing).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd, 10)


def test_merge_of_runs():
    rng = random.Random(3)
    runs = [sorted({bytes(rng.choice(b"ab\0\xff") for _ in range(12)) for _ in range(rng.randrange(0, 60))}) for _ in range(7)]
    coded = [lcp_merge.encode_run(r) for r in runs]
    assert all([s for s, _ in lcp_merge.decode_run(p, t, 12)] == r for (p, t), r in zip(coded, runs))
    merged = list(lcp_merge.merge_runs([lcp_merge.decode_run(p, t, 12) for p, t in coded]))
    assert [s for _, s, _ in merged] == sorted(s for r in runs for s in r)
    before = b""
    for which, s, prefix in merged:
        assert s in runs[which] and prefix == (lcp_merge.common_prefix(before, s) if before else 0)
        before = s
    assert list(lcp_merge.merge_runs([])) == []


def test_anchors_depend_on_the_string_alone():
    raw = np.frombuffer((prose(1, 300) + PASSAGE + prose(2, 300) + PASSAGE).encode(), np.uint8)
    text, place, first, last = anchors(raw, np.array([0, len(raw)]), 100)
    assert first[0] == 0 and last[-1] == len(raw) - 100 and (first[1:] == last[:-1] + 1).all()
    of = {i: p - i for p, a, b in zip(place, first, last) for i in range(a, b + 1)}
    seen = {}
    for i, d in of.items():
        assert seen.setdefault(bytes(raw[i : i + 100]), d) == d
    x = np.random.default_rng(1).integers(0, 50, 200)
    assert sliding_minimum(x, 7).tolist() == [x[i : i + 7].min() for i in range(194)]


# --- benchmark items --------------------------------------------------------------------

ITEMS = [(1, prose(50, 30)), (2, prose(51, 9)), (3, "Only three words"), (4, None), (5, "!!!"), (None, prose(52, 12)), (7, prose(53, 200)), (8, prose(50, 30)), (9, "word")]


def holds(doc, item):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, d = words(item), words(doc)
    if not w or doc is None:
        return None
    size = min(5, len(w))
    want = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return len(want & {tuple(d[i : i + size]) for i in range(len(d) - size + 1)}) / len(want)


def test_contaminated(spark, odd, nothing):
    rng = random.Random(2)
    rows = list(ODD)
    for k, (_, text) in enumerate(ITEMS):
        for cut in (0, 1, 3, 6):
            words = (text or "").split()
            rows.append((200 + 10 * k + cut, prose(300 + k, rng.randrange(5, 400)) + ". " + " ".join(words[: len(words) - cut]).upper() + " " + prose(400 + k, 50)))
    docs = odd_rows(spark, rows).drop("item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_shingles", F.lit(1))
    found = decontamination.contaminated(docs, items).collect()
    want = sorted((repr(d), repr(i), round(c, 9)) for d, t in rows for i, b in ITEMS if (c := holds(t, b)) is not None and c >= 0.8)
    assert sorted((repr(r["doc_id"]), repr(r["item_id"]), round(r["containment"], 9)) for r in found) == want and len(want) > 20
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(d) for d, t in rows if all((holds(t, b) or 0) < 0.8 for _, b in ITEMS))
    assert decontamination.contaminated(nothing, items).collect() == []
    assert decontamination.contaminated(odd, items.limit(0)).collect() == []
    assert decontamination.decontaminate(odd, items.limit(0)).count() == len(ODD)


def test_join_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a " + ITEMS[0][1]), (2, "b")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(1, 1)]


# --- license notices --------------------------------------------------------------------


def test_license_scan(spark, nothing):
    rng = random.Random(4)
    rows, want = list(ODD), set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for copy in range(3):
            words = text.split()
            if copy == 2 and len(words) > 30:
                words[len(words) // 2] = "changed"
            rows.append((500 + 10 * k + copy, prose(k, rng.randrange(0, 500)) + "\n" + " ".join(words).swapcase() + "\n" + prose(k + 1, rng.randrange(0, 200))))
            want.add((500 + 10 * k + copy, name))
    docs = odd_rows(spark, rows)
    got = licenses.scan(docs).collect()
    assert want <= {(r["doc_id"], r["license"]) for r in got}
    # The line forms lie within the longer notices; nothing else may be found.
    lines = {"apache-2.0-line": "apache-2.0", "gpl-3.0-line": "gpl-3.0"}
    assert {(r["doc_id"], r["license"]) for r in got} - want <= {(d, line) for d, name in want for line, whole in lines.items() if name == whole}
    texts = dict(rows)
    for r in got:
        if r["doc_id"] % 10 < 2 and (r["doc_id"], r["license"]) in want:
            part = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower()
            assert re.findall(r"\w+", part)[:3] == re.findall(r"\w+", licenses.TEMPLATES[r["license"]].lower())[:3]
    assert licenses.scan(nothing).collect() == []
    assert licenses.scan(docs, {"none": "", "null": None}).collect() == []


def test_bands_reach_their_probability():
    for group in licenses.prepare(licenses.TEMPLATES, 0.8, 1e-4):
        for s in group.sets:
            need = -(-len(s) * 8 // 10)
            assert (1 - need / (3 * group.stride + len(s) - need)) ** group.bands <= 1e-4


def test_versions_of_licenses_are_told_apart():
    """Every template, alone and between other words, is reported as itself and as nothing else."""
    import pyarrow as pa

    from corpusforge.llm.arrays import text_bytes

    names = sorted(licenses.TEMPLATES)
    assert {"gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gpl-2.0-text", "agpl-3.0-text", "isc-text", "epl-2.0", "boost-1.0", "cc-by-sa-4.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause"} <= set(names)
    texts = [prose(i, 20) + "\n" + licenses.TEMPLATES[n] + "\n" + prose(i + 1, 20) for i, n in enumerate(names)]
    found = licenses.scan_texts(*text_bytes(pa.array(texts)), licenses.prepare(licenses.TEMPLATES, 0.8, 1e-4), 0.8)
    assert [(names[r[0]], r[1], r[2]) for r in found] == [(n, n, 1.0) for n in names]


def test_shorter_repeats_are_told_beside(spark):
    catalogue = {t.name for t in spark.catalog.listTables()}
    common, notice = prose(90, 120), prose(91, 45)
    rows = [(1, common + " one " + prose(92, 30)), (2, "é" + common + " two " + notice), (3, notice + " three"), (4, None), (5, prose(93, 50)), (5, prose(93, 50)), (6, "ü" * 150 + "x" + "ü" * 150)]
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"]) for r in suffix_dedup.remove_repeats(odd_rows(spark, rows), 400, shorter=200).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((repr(d), len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest(), len(t) - len(k2), len(t) - len(k3)) for (d, _), t, (k, n), (k2, _), (k3, _) in zip(rows, texts, removed(texts, 400), removed(texts, 200), removed(texts, 101)))
    assert [g[:5] for g in got] == [w[:5] for w in want] and any(g[5] and not g[2] for g in got)
    # At least all bytes of repeated strings of 200; none where not even half of one is repeated.
    assert all(w[5] <= g[5] <= w[1] and (g[5] == 0 or w[6] > 0) for g, w in zip(got, want))
    assert {t.name for t in spark.catalog.listTables()} == catalogue


@pytest.mark.parametrize("shorter", [None, 200])
def test_query_and_columns_against_all_strings(spark, shorter):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shorter=shorter).collect()}
    texts = [t.encode() for _, t in rows]
    for (d, _), t, (kept, n) in zip(rows, texts, removed(texts, 400)):
        assert (found[d]["n_removed"], found[d]["n_spans"], found[d]["kept_sha256"]) == (len(t) - len(kept), n, hashlib.sha256(kept).hexdigest())
