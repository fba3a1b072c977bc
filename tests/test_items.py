import json

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import catalog, conversations, items

KEYS = "doc_id int, chunk_id int, generator string, attempt int, raw string"


def listed(spark, *answers):
    rows = [(i, 0, g, 1, raw) for i, (g, raw) in enumerate(answers)]
    return items.with_items(spark.createDataFrame(rows, KEYS))


@pytest.mark.parametrize(
    "generator, raw, n",
    [
        ("qa_pairs", '{"qa_pairs": [{"question": "q"}, {"question": "r"}]}', 2),
        ("qa_pairs", '```json\n{"qa_pairs": [{"question": "q"}]}\n```', 1),
        ("qa_pairs", "[1, 2, 3]", 3),
        ("qa_pairs", '{"items": [{"a": 1}, {"a": 2}], "qa_pairs": [{"a": 3}]}', 2),
        ("qa_pairs", '{"question": "q", "answer": "a"}', 1),
        ("qa_pairs", '{"summaries": ["a", "b"]}', 1),
        ("embeddings", '{"pairs": [{"sentence1": "a"}]}', 1),
        ("summaries", '{"summary": "short"}', 1),
        ("summaries", '{"summaries": ["a", "b"]}', 2),
        ("other", '{"other": [1, 2]}', 2),
        ("image_descriptions", '{"image_descriptions": [{"a": 1}, {"a": 2}, {"a": 3}]}', 3),
        ("other", '{"image_descriptions": [{"a": 1}]}', 1),
    ],
)
def test_item_counts(spark, generator, raw, n):
    assert items.explode_items(listed(spark, (generator, raw))).count() == n


def test_a_generator_of_ones_own(spark):
    lines = items.Generator("lines", (), "", {"text": "string"}, parse=lambda v: F.try_variant_get(v, "$.body.lines", "array<variant>"))
    df = spark.createDataFrame([(1, 0, "lines", 1, '{"body": {"lines": [{"text": "a"}, {"text": "b"}]}}')], KEYS)
    own = {**items.GENERATORS, "lines": lines}
    found = items.explode_items(items.with_items(df, generators=own))
    assert [r["text"] for r in items.typed_items(found, "lines", own).orderBy("item_no").collect()] == ["a", "b"]
    assert items.echo("p" * 60).startswith("Local model result for prompt: " + "p" * 50 + "...")


def test_reasons(spark):
    got = items.rejects(listed(spark, ("qa_pairs", "sorry"), ("qa_pairs", "42"), ("qa_pairs", "[]"), ("qa_pairs", None), ("qa_pairs", "[1]")))
    assert {r["doc_id"]: r["reason"] for r in got.collect()} == {0: "not_json", 1: "unexpected_type", 2: "empty", 3: "pending"}


def test_items_and_rejects_cover_all_answers(spark):
    all_of = listed(spark, ("qa_pairs", "x"), ("qa_pairs", "[1]"), ("summaries", "7"))
    assert items.explode_items(all_of).select("doc_id").distinct().count() + items.rejects(all_of).count() == 3


def test_summaries_take_bare_strings(spark):
    found = items.explode_items(listed(spark, ("summaries", '{"summaries": ["a", {"summary": "b", "original_text": "o"}]}')))
    got = items.typed_items(found, "summaries").orderBy("item_no").collect()
    assert [(r["summary"], r["original_text"]) for r in got] == [("a", None), ("b", "o")]


def test_conversations_of_speakers(spark):
    raw = '{"conversations": [{"speaker": "A", "text": "hi"}, {"messages": [{"role": "user", "content": "yo"}]}, {"odd": 1}]}'
    got = items.conversation_messages(items.explode_items(listed(spark, ("conversations", raw)))).orderBy("item_no").collect()
    assert [[tuple(m) for m in r["messages"]] for r in got] == [[("A", "hi")], [("user", "yo")]]


def test_tags_do_not_replace(spark):
    found = items.explode_items(listed(spark, ("qa_pairs", '[{"generator": "mine"}, {"question": "q"}]')))
    got = items.tag_metadata(found, F.lit("now")).orderBy("item_no").collect()
    assert [(r["item_generator"], r["item_timestamp"]) for r in got] == [("mine", "now"), ("qa_pairs", "now")]


def test_retry_fills_schema_and_previous(spark):
    df = spark.createDataFrame([(1, 0, "qa_pairs", 1, "```\nno {x}\n```"), (2, 0, "qa_pairs", 3, "no"), (3, 0, "qa_pairs", 1, "[]")], KEYS)
    got = items.retry_requests(items.with_items(df)).collect()
    assert [(r["doc_id"], r["attempt"]) for r in got] == [(1, 2)]
    assert got[0]["prompt"].endswith("Previous output:\nno {x}") and '"qa_pairs"' in got[0]["prompt"]


def test_override_keeps_empty_media_keys(spark):
    schema = "doc_id int, generator string, item string"
    text = spark.createDataFrame([(1, "qa_pairs", "t"), (1, "summaries", "t"), (2, "qa_pairs", "t")], schema)
    media = spark.createDataFrame([(1, "qa_pairs", "m")], schema)
    keys = spark.createDataFrame([(1, "qa_pairs"), (2, "qa_pairs")], "doc_id int, generator string")
    got = {tuple(r) for r in items.override_union(text, media, keys).collect()}
    assert got == {(1, "summaries", "t"), (1, "qa_pairs", "m")}


def test_columns_and_types_come_from_the_items(spark, tmp_path):
    from corpusforge.sinks import writers

    raw = '[{"n": 1, "x y": " a ", "m": [1, "z"], "OBJECT<": true, "doc_id": "k"}, {"n": 2.5, "m": {"o": "é"}, "v": 1}, {"v": "t", "q`": null}, "bare"]'
    found = items.explode_items(listed(spark, ("own", raw), ("other", '[{"else": 1}]')))
    schemas = items.item_schemas(found, ["own", "other", "none"])
    types = {f.name: f.dataType.typeName() for f in schemas["own"][0]}
    assert types == {"n": "double", "x y": "string", "m": "string", "OBJECT<": "boolean", "doc_id": "string", "v": "string", "q`": "string"}
    rows = [r.asDict() for r in items.typed_columns(found, "own", *schemas["own"]).orderBy("item_no").collect()]
    assert [r["n"] for r in rows] == [1.0, 2.5, None, None] and [r["v"] for r in rows] == [None, "1", "t", None]
    assert [r["m"] for r in rows] == ['[1,"z"]', '{"o":"é"}', None, None] and rows[3]["item"] == "bare"
    assert rows[0]["item.doc_id"] == "k" and rows[0]["x y"] == " a " and rows[0]["OBJECT<"] is True
    writers.write_typed_csv(found, str(tmp_path / "csv"), ["own", "other"])
    back = spark.read.options(**writers.CSV, multiLine="true").csv(str(tmp_path / "csv/own"))
    assert back.columns == sorted([*types.keys() - {"doc_id"}, "item", "item.doc_id", "doc_id", "chunk_id", "item_no"])
    assert back.filter("item_no = 0").select("x y").first()[0] == " a "
    assert items.typed_columns(found, "none", *schemas["none"]).columns == ["doc_id", "chunk_id", "item_no"]
    assert items.item_schemas(found.limit(0), ["own"])["own"][0].names == []


def test_filter_sample_and_header(spark):
    found = items.explode_items(listed(spark, ("qa_pairs", '[{"b": 1, "a": 2}, {"c": 3}]')))
    assert sorted(r["field"] for r in items.csv_header(found).collect()) == ["a", "b", "c"]
    df = spark.range(100)
    first = [r["id"] for r in items.sample_items(df, F.col("id"), 5, None).collect()]
    random = [r["id"] for r in items.sample_items(df, F.col("id"), 5, 7).collect()]
    assert first == [0, 1, 2, 3, 4] and random == [r["id"] for r in items.sample_items(df, F.col("id"), 5, 7).collect()]


def test_completion_hook_retries_and_reports(spark):
    prompts = spark.createDataFrame([(1, 0, "g", "good"), (2, 0, "g", "bad"), (3, 0, "g", "flaky")], "doc_id int, chunk_id int, generator string, prompt string")
    seen = {}

    def call(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "bad" or (prompt == "flaky" and seen[prompt] == 1):
            raise RuntimeError("429 quota")
        return json.dumps({"echo": prompt})

    got = {r["doc_id"]: r for r in items.complete(prompts, call, max_retries=2, backoff=0.0, concurrency=2).collect()}
    assert got[1]["raw"] == '{"echo": "good"}' and got[1]["calls"] == 1
    assert got[2]["raw"] is None and got[2]["error"] == "429 quota" and got[2]["calls"] == 2
    assert got[3]["raw"] and got[3]["calls"] == 2 and got[3]["error"] is None


@pytest.mark.parametrize(
    "raw, items_json",
    [
        ('{"summary":"s","original_text":"t"}', ['{"original_text":"t","summary":"s"}']),
        ('{"summaries":["a","b"]}', ['{"summary":"a"}', '{"summary":"b"}']),
        ('["a",{"summary":"b"}]', ['{"summary":"a"}', '{"summary":"b"}']),
        ('{"summary":"x"}', ['{"summary":"x"}']),
    ],
)
def test_summaries_are_objects(spark, raw, items_json):
    found = items.explode_items(listed(spark, ("summaries", raw))).orderBy("item_no")
    assert [r["j"] for r in found.select(F.to_json("item").alias("j")).collect()] == items_json


def test_long_conversation_stays_one(spark):
    turns = spark.range(2500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = conversations.flatten_turns(turns).collect()
    assert {r["conversation_length"] for r in rows} == {2500} and sorted((r["message_index"], int(r["content"])) for r in rows) == [(i, i) for i in range(2500)]
    assert conversations.chat_jsonl(conversations.collect_messages(turns)).count() == 1


def test_flatten_undoes_collect(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    flat = conversations.flatten_conversations(conversations.collect_messages(turns))
    back = flat.select(F.col("conversation_id").alias("conv_id"), F.col("message_index").cast("long").alias("turn"), "role", F.col("content").alias("text"))
    assert back.exceptAll(turns).count() == 0 and back.count() == turns.count()


def test_priority_and_prices(spark):
    rows = [("a", 1, 1), ("a", 5, 2), ("a", 5, 3), ("b", 0, 9)]
    entries = spark.createDataFrame(rows, "provider string, priority int, seq int")
    assert {tuple(r) for r in catalog.pick_highest_priority(entries).collect()} == {("a", 5, 2), ("b", 0, 9)}
    calls = spark.createDataFrame([("openai", "gpt-4o", 1000), ("openai", "none", 1000)], "provider string, model string, tokens int")
    got = {r["model"]: r["cost"] for r in catalog.cost_report(calls, catalog.model_catalog(spark), ["provider"]).collect()}
    assert got == {"gpt-4o": 20.0, "none": 0.0}


def test_provider_choice(spark):
    asked = [(1, "openai", "gpt-4-turbo"), (2, "openai", "nope"), (3, "nobody", "gemini-pro"), (4, None, None), (5, "mistral", "mistral-small-latest")]
    req = spark.createDataFrame(asked, "id int, provider string, model string")
    cat = catalog.model_catalog(spark)
    got = {r["id"]: (r["provider"], r["model"]) for r in catalog.resolve_provider(req, cat).collect()}
    assert got == {
        1: ("openai", "gpt-4-turbo"),
        2: ("openai", "gpt-4o"),
        3: ("google", "gemini-pro"),
        4: ("anthropic", "claude-3-5-sonnet-20241022"),
        5: ("mistral", "mistral-small-latest"),
    }
    vision = {r["id"]: r["provider"] for r in catalog.resolve_provider(req, cat, vision_only=True).collect()}
    assert vision[5] == "anthropic"
