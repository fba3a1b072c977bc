"""The flows end to end: files to documents, documents to items."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import items, render, runs
from corpusforge.plans import extract, generate
from corpusforge.settings import Settings
from corpusforge.sources import files

PROSE = "This is a sentence of plain words for the test number %d. It has a second sentence too!  Is there a third? "


def test_extract_gives_a_row_for_every_file(spark, tmp_path):
    (tmp_path / "good.txt").write_text("".join(PROSE % i for i in range(20)))
    (tmp_path / "short.txt").write_text("tiny")
    (tmp_path / "poor.txt").write_text("a " * 120)
    (tmp_path / "big.txt").write_text("x" * 9000)
    (tmp_path / "other.docx").write_text("word")
    (tmp_path / "bad.epub").write_text("not a book")
    (tmp_path / "mine.pdf").write_text("".join(PROSE % i for i in range(20)))
    (tmp_path / "fails.pdf").write_text("?")

    def read_pdf(path, content):
        if content == b"?":
            raise ValueError("encrypted")
        return {"text": content.decode(), "images": [{"page_num": 1}, {"page_num": 2}]}

    scanned = files.scan_files(spark, str(tmp_path), pattern="*")
    docs = extract.extract_documents(scanned, Settings(max_file_size=8000), [files.Extractor((".pdf",), read_pdf)])
    got = {r["stem"] + "." + r["path"].rsplit(".", 1)[1]: r for r in docs.collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "good.txt": "ok", "short.txt": "too_short", "poor.txt": "low_quality", "big.txt": "too_large",
        "other.docx": "unsupported", "bad.epub": "error", "mine.pdf": "ok", "fails.pdf": "error",
    }
    assert got["fails.pdf"]["error"] == "encrypted" and "  " not in got["good.txt"]["text"] and got["poor.txt"]["text"] == ""
    log = extract.run_log(docs)
    assert runs.run_summary(log).first().asDict()["files_successful"] == 2
    assert {r["path"].rsplit("/", 1)[1]: r["image_count"] for r in log.filter("success").collect()} == {"good.txt": 0, "mine.pdf": 2}


def test_generate_asks_again_and_loses_nothing(spark):
    docs = spark.createDataFrame([(i, "Some text. " * 3) for i in range(6)], "doc_id long, text string")
    settings = Settings(text_generators=("qa_pairs", "summaries"), custom_prompts={"qa_pairs": "QA {chunk}", "summaries": "SUM {text}"})
    prompts = generate.text_prompts(docs.withColumn("text", F.concat("text", F.lit("id="), F.col("doc_id").cast("string"))), settings)

    def call(prompt):
        if "Previous output" in prompt:
            return json.dumps({"qa_pairs": [{"question": "again", "answer": "yes"}]}) if "nope 1" in prompt else "never"
        number = prompt.rsplit("id=", 1)[1]
        if prompt.startswith("QA") and number in "12":
            return f"nope {number}"
        return json.dumps({"qa_pairs": [{"question": "q", "answer": number}]} if prompt.startswith("QA") else {"summaries": ["s", "t"]})

    found, lost = generate.generate(prompts, call, backoff=0.0, concurrency=2)
    qa = items.typed_items(found, "qa_pairs")
    assert {r["doc_id"]: r["question"] for r in qa.collect()} == {0: "q", 1: "again", 3: "q", 4: "q", 5: "q"}
    assert items.typed_items(found, "summaries").count() == 12
    assert [(r["doc_id"], r["generator"], r["reason"]) for r in lost.collect()] == [(2, "qa_pairs", "not_json")]


def test_generate_from_media_with_fallback(spark):
    media = spark.createDataFrame([(1, "a.png"), (2, "b.png")], "doc_id long, media_path string")
    prompts = generate.media_prompts(media, {"image_qa": "Describe"})

    def call(prompt, path):
        raise RuntimeError("down")

    def fallback(prompt, path):
        return json.dumps({"items": [{"about": path}]})

    found, lost = generate.generate(prompts, call, rounds=1, media="media_path", fallback=fallback, max_retries=2, backoff=0.0)
    assert sorted(json.loads(r["j"])["about"] for r in found.select(F.to_json("item").alias("j")).collect()) == ["a.png", "b.png"]
    assert lost.count() == 0


def test_media_items_replace_text_items(spark):
    docs = spark.createDataFrame([(i, f"Some plain text, id={i}") for i in range(3)], "doc_id long, text string")
    media = spark.createDataFrame([(1, "a.png"), (2, "none.png"), (9, "only.png")], "doc_id long, media_path string")

    def call(prompt, *path):
        if path:
            return "[]" if path[0] == "none.png" else json.dumps([{"question": path[0]}])
        return json.dumps([{"question": "text", "summary": "text"}])

    chosen = Settings(text_generators=("qa_pairs", "summaries"))
    found, lost = generate.generate_full(docs, media, {"qa_pairs": "Describe"}, call, chosen, rounds=1, backoff=0.0)
    qa = items.typed_items(found, "qa_pairs")
    assert {r["doc_id"]: r["question"] for r in qa.collect()} == {0: "text", 1: "a.png", 9: "only.png"}
    assert sorted(r["doc_id"] for r in items.typed_items(found, "summaries").collect()) == [0, 1, 2]
    assert [(r["doc_id"], r["reason"]) for r in lost.collect()] == [(2, "empty")]


@pytest.mark.parametrize("stop", [3, 99])
def test_a_stopped_run_goes_on(spark, stop):
    rows = [(i, f"f{i}", i % 4 != 1, 1.0, None) for i in range(8)]
    log = spark.createDataFrame(rows, "seq long, path string, success boolean, seconds double, error string")
    handled = []

    def run(left):
        handled.extend(sorted(r["path"] for r in left.collect()))
        return left.select(F.col("n").alias("seq"), "path", F.lit(True).alias("success"), F.lit(0.5).alias("seconds"), F.lit(None).cast("string").alias("error"))

    files = spark.createDataFrame([(f"f{i}", 100 + i) for i in range(10)], "path string, n long")
    out = extract.resume(files, log, run, max_failures=9, max_files=stop)
    kept = 3 if stop == 3 else 8
    assert {r["path"]: (r["run"], r["seq"]) for r in out.collect()} == {f"f{i}": ("before", i) if i < kept else ("resumed", 100 + i) for i in range(10)}
    assert handled == [f"f{i}" for i in range(kept, 10)]


def test_a_format_and_a_writer_of_ones_own(spark, monkeypatch, tmp_path):
    from corpusforge.sinks import writers

    own = render.DocumentFormat(lambda kind: F.lit(kind), lambda kind, columns: F.concat(F.lit("* "), F.col("summary")))
    monkeypatch.setitem(render.FORMATS, "list", own)
    monkeypatch.setitem(writers.WRITERS, "table", lambda df, path, keys: df.write.parquet(path))
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "doc string, item_no long, summary string")
    assert [r["block"] for r in render.render_blocks(rows, ["doc"], "summaries", "list").orderBy("block_no").collect()] == ["summaries", "* x", "* y"]
    writers.write_items(rows, str(tmp_path / "t"), "summaries", "table", ["doc"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_images_too_small_or_poor_are_dropped(spark):
    from corpusforge.plans.extract import _kept_images

    listed = '[{"area":50000,"quality_score":0.9},{"width":10,"height":10},{"area":90000,"quality_score":0.1},{"area":90000,"single_color":true},{"name":"x"},"plain.png"]'
    df = spark.createDataFrame([(listed,), ("[]",), (None,)], "images string")
    got = [r["i"] for r in df.select(_kept_images(F.col("images"), Settings(min_image_size=1000, skip_single_color_images=True)).alias("i")).collect()]
    assert got == ['[{"area":50000,"quality_score":0.9},{"name":"x"},"plain.png"]', "[]", None]


def test_header_lines_go_in_the_corpus_flow(spark):
    from corpusforge.plans.corpus import clean_documents

    body = "A sentence of several plain words stands here for the score. " * 6
    df = spark.createDataFrame([(1, f"PAGE 7\n{body}")], "doc_id long, text string")
    assert clean_documents(df, Settings(header_regex=r"^page \d+$")).first()["text"] == body.strip()


def test_failed_calls_keep_their_error(spark):
    from corpusforge.plans.generate import generate

    def call(prompt: str) -> str:
        raise RuntimeError("429")

    prompts = spark.createDataFrame([(1, 0, "qa_pairs", "p")], "doc_id long, chunk_id int, generator string, prompt string")
    items, rejected = generate(prompts, call, rounds=1, max_retries=2, backoff=0.0, concurrency=1)
    assert items.count() == 0
    assert [(r["reason"], r["error"], r["calls"]) for r in rejected.collect()] == [("call_failed", "429", 2)]


def test_costs_of_output_and_images(spark):
    from corpusforge.operators import catalog

    calls = spark.createDataFrame([("p", "m", 1000, 500, 2), ("p", "m", 1000, 500, None)], "provider string, model string, tokens long, out long, images long")
    prices = spark.createDataFrame([("p", "m", 1.0, 2.0, 0.5)], "provider string, model string, input_per_1k double, output_per_1k double, image_price double")
    assert sorted(r["cost"] for r in catalog.with_cost(calls, prices, output_tokens="out", images="images").collect()) == [2.0, 3.0]
    assert catalog.cost_report(calls, prices, ["provider"], output_tokens="out", images="images").first()["cost"] == 5.0


def test_prompts_of_a_round_are_dealt_into_waves(spark, monkeypatch):
    """A task asks a bounded part of the prompts, however many there are, and never more tasks than calls run at a time."""
    def call(prompt):
        from pyspark.taskcontext import TaskContext

        task = TaskContext.get()
        return json.dumps({"qa_pairs": [{"question": f"{task.stageId()}/{task.partitionId()}", "answer": prompt}]})

    prompts = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.lit("qa_pairs").alias("generator"), F.format_string("prompt %090d", "id").alias("prompt"))
    monkeypatch.setattr(generate, "TASK_BYTES", 2000)
    found, lost = generate.generate(prompts, call, rounds=1, concurrency=3)
    rows = items.typed_items(found, "qa_pairs").collect()
    assert sorted(r["answer"] for r in rows) == [f"prompt {i:090d}" for i in range(400)] and lost.count() == 0
    tasks = {}
    for r in rows:
        tasks[r["question"]] = tasks.get(r["question"], 0) + len(r["answer"])
    assert max(tasks.values()) <= 2 * 2000
    assert {int(t.split("/")[1]) for t in tasks} <= {0, 1, 2}


def test_no_prompts_give_no_answers(spark):
    prompts = spark.createDataFrame([], "doc_id long, chunk_id int, generator string, prompt string")
    found, lost = generate.generate(prompts, lambda prompt: "x", concurrency=2)
    assert found.count() == 0 and lost.count() == 0
