"""Learned operators on small labelled tables, and the rules on lines."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_tables import ODD, nothing, odd, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from corpusforge.llm import language, line_rules, quality_grades, toxicity
from corpusforge.llm.arrays import text_bytes
from corpusforge.llm.folds import fold
from corpusforge.llm.oracles import ORACLES

INSULTS = ["idiot", "moron", "stupid", "loser"]


def test_fold_is_crc32(spark):
    import zlib

    rows = spark.range(50).union(spark.createDataFrame([(None,)], "id long")).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(b"" if r["id"] is None else str(r["id"]).encode()) % 5 for r in rows)


# --- toxicity ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def insulting(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        words = prose(i, rng.randrange(5, 80)).split()
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def detector(insulting):
    return toxicity.train(insulting.select("doc_id", "toxic"), insulting.select("doc_id", "text"))


def test_toxicity_finds_insults(spark, insulting, detector):
    wrong = toxicity.score(insulting, detector).join(insulting.select("doc_id", "toxic"), "doc_id").filter("predicted <> toxic").count()
    assert wrong == 0
    said = ["You MORON!", "an m-o-r-o-n he is", "s t u p i d thing", "what an idi.ot.", "st*upid", "l0ser"]
    fine = ["a river and stones", "", None, "12 34 !!", "amber lanterns " * 2000]
    rows = spark.createDataFrame(list(enumerate(said + fine)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(rows, detector).collect()}
    assert [got[i]["predicted"] for i in range(len(said + fine))] == [1] * len(said) + [0] * len(fine)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_margin_is_the_kernel_expansion(detector):
    """The folded weights give what explicit feature vectors give."""
    words = ["moron", "stuupid", "river", "lantern", "ab", ""]
    assert np.allclose(detector.margins([toxicity.spell(w) for w in words]), toxicity.vectors(words) @ detector.weights + detector.bias, atol=1e-4)
    one = toxicity.vectors(["moron"])[0]
    assert np.isclose((one**2).sum(), 1, atol=1e-5)
    # The start sign and m, o, r, o, n: all triples lie within the span.
    assert (one > 0).sum() == len({(a, b, c) for i, a in enumerate("^moron") for j, b in enumerate("^moron") for k, c in enumerate("^moron") if i < j < k})


def test_toxicity_of_odd_rows(spark, odd, nothing, detector):
    rows = toxicity.score(odd, detector).collect()
    assert len(rows) == len(ODD) and all(r["score"] is not None for r in rows)
    assert toxicity.score(nothing, detector).collect() == []
    kept = toxicity.reject_toxic(odd, detector)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.reject_toxic(nothing, detector).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None), (4, 0), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit(1))
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.train(labels, odd)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.train(labels.limit(0), nothing)).collect()} == {0}


# --- grades -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rated(spark):
    rng, rows = random.Random(2), []
    for i in range(450):
        level = i % 3
        words = prose(i, rng.randrange(30, 60)).split()
        junk = [w + "$$" for w in words]
        share = (1.0, 0.4, 0.0)[level]
        rows.append((i, " ".join(j if rng.random() < share else w for w, j in zip(words, junk)), [1, 2, 5][level]))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_grades_are_ordered(rated):
    model = quality_grades.train(rated.filter("doc_id < 300").select("doc_id", "quality"), rated)
    assert model.grades == (1.0, 2.0, 5.0) and (np.diff(model.thresholds) > 0).all()
    rows = quality_grades.grade(rated, model).join(rated.select("doc_id", "quality"), "doc_id").filter("doc_id >= 300").collect()
    assert np.mean([r["predicted_grade"] == r["quality"] for r in rows]) > 0.9
    for r in rows:
        p = [1 - r["tail"][0], r["tail"][0] - r["tail"][1], r["tail"][1]]
        assert min(p) >= -1e-12 and np.isclose(r["expected_grade"], p[0] * 1 + p[1] * 2 + p[2] * 5) and r["top_probability"] == r["tail"][1]


def test_gradient_of_the_likelihood():
    """Descent lowers the loss to where no coordinate step lowers it much."""
    rng = np.random.default_rng(0)
    n, keys = 60, np.tile(np.arange(3), 60)
    values = rng.normal(size=3 * n)
    level = np.clip((values.reshape(n, 3)[:, 0] * 2 + rng.normal(size=n) * 0.3 + 1.5).astype(int), 0, 2)
    bounds = np.arange(0, 3 * n + 1, 3)
    w, theta = quality_grades._fit(keys, values, bounds, level, 3, 1e-3, 3000)

    def loss(w, theta):
        s = 1 / (1 + np.exp(-((values.reshape(n, 3) @ w[:3])[:, None] - theta)))
        tail = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        return -np.log(tail[np.arange(n), level] - tail[np.arange(n), level + 1]).mean() + 5e-4 * (w**2).sum()

    best = loss(w, theta)
    for i in range(3):
        for step in (-0.2, 0.2):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, theta) > best - 1e-3
    for i in range(2):
        for step in (-0.2, 0.2):
            moved = theta.copy()
            moved[i] += step
            assert loss(w, moved) > best - 1e-3


def test_grades_of_odd_rows(spark, odd, nothing, rated):
    model = quality_grades.train(rated.select("doc_id", "quality"), rated)
    rows = quality_grades.grade(odd, model).collect()
    assert len(rows) == len(ODD) and all(1 <= r["expected_grade"] <= 5 for r in rows)
    assert quality_grades.grade(nothing, model).collect() == []
    one = spark.createDataFrame([(1, 4), (2, 4), (None, 1), (3, None)], "doc_id long, quality int")
    assert {r["expected_grade"] for r in quality_grades.grade(odd, quality_grades.train(one, odd)).collect()} == {4.0}
    assert {r["expected_grade"] for r in quality_grades.grade(odd, quality_grades.train(one.limit(0), nothing)).collect()} == {None}


# --- language ---------------------------------------------------------------------------

TONGUES = {"aa": "ba be bi bo bu da de di do du".split(), "bb": "kra kre kri stro stru plö plä".split(), "cc": "lé né mé sou vou tou".split()}


def say(tongue: str, seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(TONGUES[tongue]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def naive_phrases(plain: bytes, text: bytes) -> int:
    count = 0
    for start in range(0, len(plain), language.STRETCH):
        piece, at = plain[start : start + language.STRETCH], 0
        while at < len(piece):
            size = 1
            while at + size < len(piece) and piece[at : at + size + 1] in text and piece[at : at + size] in text:
                size += 1
            count += 1
            at += size
    return count


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, say(t, i, 40), t) for i, t in enumerate(list(TONGUES) * 20)]
    return spark.createDataFrame([*rows, (900, "x", None), (None, "y", "aa"), (901, None, "bb")], "doc_id long, text string, lang string")


def test_phrases_are_longest_matches(tongues):
    model = language.train(tongues, documents=5, letters=600)
    texts = [say(t, 99, n) for t in TONGUES for n in (1, 5, 700)] + ["", "zzz qqq", "BA, be!!bi", None]
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    got, _ = language.phrases(raw, offsets, model)
    letters, bounds = language.plain(raw, offsets)
    for i in range(len(texts)):
        plain = letters[bounds[i] : bounds[i + 1]].tobytes()
        assert got[:, i].tolist() == [naive_phrases(plain, t) for t in model.texts]


def test_language(spark, tongues, odd, nothing):
    model = language.train(tongues)
    assert model.languages == ("aa", "bb", "cc")
    rows = spark.createDataFrame([(i, say(t, 500 + i, 12), t) for i, t in enumerate(list(TONGUES) * 10)], "doc_id long, text string, lang string")
    assert language.identify(rows, model).join(rows, "doc_id").filter("lang_pred <> lang").count() == 0
    und = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? —"), (4, " \n")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(und, model).collect()} == {("und", 0.0)}
    got = language.identify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(nothing, model).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd, language.train(tongues.limit(0))).collect()} == {"und"}


# --- rules on lines ---------------------------------------------------------------------


def test_line_rules_against_sql(spark):
    rng, rows = random.Random(3), [r for r in ODD if r[0] not in (2, None)]
    common = ["Read  more on our SITE today", "subscribe now and never miss a post of this blog again please"]
    for i in range(300):
        lines = [prose(rng.randrange(10_000), rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))]
        lines += [rng.choice([c, c.lower(), c.replace(" ", "\t")]) for c in common if rng.random() < 0.4]
        if i % 10 == 0:
            lines = [prose(7, 9)] * rng.randrange(1, 6)
        rng.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines)))
    docs = odd_rows(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    answer = con.execute(ORACLES["op9_line_rules"])
    names = [c[0] for c in answer.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in answer.fetchall()}
    got = {r["doc_id"]: r.asDict() for r in line_rules.quality_rules(docs).collect()}
    sourced = {r["doc_id"] for r in docs.filter("source IS NOT NULL").select("doc_id").collect()}
    assert got.keys() == want.keys()
    for d in want:
        for name in names:
            # SQL's join leaves out a null host, which here is a host like any other.
            if d in sourced or name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
                assert got[d][name] == want[d][name], (d, name)
    assert any(r["boilerplate_words"] for r in got.values()) and {r["kept"] for r in got.values()} == {True, False}


def test_line_rules_of_odd_rows(odd, nothing):
    rows = line_rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert line_rules.quality_rules(nothing).collect() == []


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(80)] + ["a " * 500]
    got = {r["doc_id"]: r["n_repeat_words"] for r in line_rules.rule_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, r in enumerate(runs) if runs.count(r) > 1 for p in range(k, k + 8)}
        assert got[i] == len(covered)


def test_frequent_lines_leave_the_text(spark):
    menu, rows = "Home  About\tContact us today", []
    for i in range(60):
        host, own = ("a", "b", None)[i % 3], [prose(2 * i, 25), "", prose(2 * i + 1, 12)]
        own.insert(i % 4, menu.upper() if i % 2 else menu) if host == "a" or i < 6 else None
        rows.append((i, "\n".join(own), host, 7))
    rows += [(60, None, "a", 7), (61, "too short\n" + menu, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").withColumn("kept", F.lit("mine"))
    got = {r["doc_id"]: r for r in line_rules.clean(docs, least_documents=5).collect()}
    assert sorted(got) == list(range(60)) and line_rules.clean(docs).columns == docs.columns
    for i, text, host, n in rows[:60]:
        left = "\n".join(x for x in text.split("\n") if host != "a" or "about" not in x.lower())
        assert (got[i]["text"], got[i]["n_chars"], got[i]["kept"]) == (left, n if left == text else len(left), "mine")
    figures = {r["doc_id"]: r for r in line_rules.quality_rules(docs, least_documents=5).collect()}
    for i, text, _, _ in rows[:60]:
        assert figures[i]["boilerplate_words"] == len(text.split()) - len(got[i]["text"].split())
    # Two documents of each other host have the line: only an absolute limit takes it.
    few = {r["doc_id"]: r["text"] for r in line_rules.clean(docs, least_documents=5, most_documents=1).collect()}
    assert all("about" not in t.lower() for t in few.values())


def test_frequent_lines_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30) + "\nsame line", "h") for i in range(30)], "doc_id long, text string, source string")
    monkeypatch.setattr(line_rules, "BROADCAST_LINES", -1)
    assert {r["text"] for r in line_rules.clean(docs).collect()} == {prose(i, 30) for i in range(30)}


# --- samples that are bounded per label -------------------------------------------------


def test_grades_keep_the_shares_of_all_labels(spark):
    """All texts are alike, so all that can be learned is the share of a grade."""
    rows = [(i, prose(1, 12), 2 if i % 10 == 0 else 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_grades.train(docs, docs, most=40)
    assert all(0.08 < r["top_probability"] < 0.12 for r in quality_grades.grade(docs, model).collect())


def test_toxic_words_by_the_shares_of_all_labels(spark):
    """A word of 60 toxic and 160 clean texts is no insult, though of the sample its texts are mostly toxic."""
    rows = [(i, prose(i, 12) + (" blunder" if i % 100 < 60 and i < 100 or i >= 100 and i % 10 == 0 else ""), int(i < 100)) for i in range(1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "toxic"), docs.select("doc_id", "text"), most_clean=60)
    assert toxicity.score(docs, model).filter("predicted = 1").count() == 0


def test_probability_curve_by_weight():
    margin, y = np.repeat([0.0, 1.0], 50), np.tile([0.0, 1.0], 50)
    slope, shift = toxicity._probability_line(margin, y, np.where(y > 0, 1.0, 9.0))
    assert np.isclose(1 / (1 + np.exp(-shift)), 0.1, atol=0.03) and abs(slope) < 0.1


def test_grades_without_texts_are_not_learned(spark):
    docs = spark.createDataFrame([(1, prose(1, 60)), (2, prose(2, 60)), (3, None), (1, prose(1, 60))], "doc_id long, text string")

    def grades(rows):
        model = quality_grades.train(spark.createDataFrame(rows, "doc_id long, quality int"), docs)
        return model.grades, {r["predicted_grade"] for r in quality_grades.grade(docs, model).collect()}

    assert grades([(1, 1), (99, 0)]) == ((1.0,), {1.0})
    assert grades([(1, 1), (3, 0)]) == ((1.0,), {1.0})
    assert grades([(98, 1), (99, 0)]) == ((), {None})
    learned, predicted = grades([(1, 1), (2, 3), (99, 2)])
    assert learned == (1.0, 3.0) and predicted <= {1.0, 3.0}


@pytest.mark.parametrize("sizes, total, level", [([], 10, 0), ([3, 4], 10, 4), ([1, 100, 100], 21, 10), ([50] * 4, 100, 25), ([0, 0, 7], 7, 7)])
def test_short_texts_leave_their_room_to_long_ones(sizes, total, level):
    assert language.fill_level(sizes, total) == level
    assert sum(min(s, level) for s in sizes) <= total


def test_few_long_texts_fill_the_bound(spark):
    """Five long texts give as many letters as many short ones; rows that share an id count once."""
    long_text, short = "wörter aus silben " * 600, "mots courts "
    rows = [(i, long_text, "de") for i in range(5)] + [(5, short * 3, "de")] * 3 + [(100 + i, short * 20, "fr") for i in range(150)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 150, 20_000)
    learned = dict(zip(model.languages, map(len, model.texts)))
    assert 0.98 * 20_000 <= learned["de"] <= 20_200 and 0.98 * 20_000 <= learned["fr"] <= 20_200


def test_stretches_change_no_prediction(spark, monkeypatch):
    """Counts of phrases broken at stretches are within 1 % of an unbroken parse, and the same language wins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.filter("doc_id % 3 <> 1"))
    texts = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    broken, lengths = language.phrases(raw, offsets, model)
    monkeypatch.setattr(language, "STRETCH", 1 << 22)
    whole, _ = language.phrases(raw, offsets, model)
    bits = model.machines()[2][:, None]
    assert ((broken * bits).argmin(0) == (whole * bits).argmin(0)).all()
    assert (np.abs(broken - whole) <= 1 + lengths // 1024).all() and abs(broken.sum() / whole.sum() - 1) < 0.01
