"""The pipeline on the smallest tables: every stage against its own input by brute force."""

import zlib

import numpy as np
import pytest
from test_duplicates import holds, removed
from test_near_copies import least_of_near_copies
from test_texts import ids_of

import corpus_pipeline
from corpusforge.llm import toxicity
from corpusforge.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = read_table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out.append((docs, after))
        docs = after
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(results):
    for name in ("toxicity", "simhash", "suffix_dedup", "decontamination"):
        assert results[name][1].dtypes == results[name][0].dtypes


def test_toxicity_stage(spark, results):
    before, after = results["toxicity"]
    model = toxicity.train(read_table(spark, SMALL, "labels"), before)
    fine = {r["doc_id"] for r in toxicity.score(before, model).filter("predicted = 0").collect()}
    assert rows_of(after) == {d: r for d, r in rows_of(before).items() if d in fine}


def test_simhash_stage(results):
    """One document of each group of texts that share 80 % of their 5-word shingles, told by comparing all sets."""
    before, after = (rows_of(x) for x in results["simhash"])
    keep = least_of_near_copies([(d, r["text"]) for d, r in before.items()])
    assert after == {d: r for d, r in before.items() if d in keep} and len(after) < len(before)


def test_suffix_stage(results):
    before, after = (rows_of(x) for x in results["suffix_dedup"])
    order = list(before)
    left = removed([before[d]["text"].encode() for d in order], 200)
    want = {d: kept.decode("utf-8", "ignore") for d, (kept, _) in zip(order, left)}
    assert {d: r["text"] for d, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r["text"] != before[d]["text"])


def test_decontamination_stage(spark, results):
    before, after = (rows_of(x) for x in results["decontamination"])
    items = [r["text"] for r in read_table(spark, SMALL, "benchmark").collect()]
    assert after == {d: r for d, r in before.items() if all((holds(r["text"], i) or 0) < 0.8 for i in items)}


def test_packing_stage(results):
    before, after = results["packing"]
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    docs = rows_of(before)
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        ids = np.array(ids_of("word_bpe_49k.json", docs[d]["text"]), "<u4")
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)


def test_run(spark, results):
    names = "doc_id start length ids_crc32 doc_tokens".split()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(*names).filter("start = 0").select("doc_id", "doc_tokens").collect()))
    assert got == sorted(map(tuple, results["packing"][1].filter("start = 0").select("doc_id", "doc_tokens").collect()))


def test_stages_take_empty_and_odd_tables(spark):
    from odd_tables import odd_rows

    odd = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SMALL).collect() == []
        after = stage(spark, odd, SMALL)
        assert after.columns == odd.columns or name == "packing"
        after.collect()
