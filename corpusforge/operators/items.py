"""From completions to training items: parsing, typing, tagging, merging."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from corpusforge import fixed_values as fixed
from corpusforge.functions.prompts import retry_prompt
from corpusforge.functions.text import let, strip, strip_code_fence


@dataclass(frozen=True)
class Generator:
    """A kind of training item: the keys its list may stand under, its schema, its typed view."""

    name: str
    keys: tuple[str, ...]
    schema: str
    fields: dict[str, str]
    wrap: str | None = None  # field that takes a bare string item
    parse: Callable[[Column], Column] | None = None  # own way from a parsed answer to an array of items


GENERATORS = {
    g.name: g
    for g in (
        Generator(
            "conversations",
            ("conversations",),
            '{"conversations": [{"messages": [{"role": "string", "content": "string"}]}]}',
            {"messages": "array<struct<role:string,content:string>>"},
        ),
        Generator(
            "qa_pairs",
            ("qa_pairs",),
            '{"qa_pairs": [{"question": "string", "answer": "string"}]}',
            {"question": "string", "answer": "string"},
        ),
        Generator(
            "embeddings",
            ("embeddings", "pairs"),
            '{"embeddings": [{"sentence1": "string", "sentence2": "string", "similarity": 0.0}]}',
            {"sentence1": "string", "sentence2": "string", "similarity": "double"},
        ),
        Generator(
            "summaries",
            ("summaries", "summary"),
            '{"summaries": ["string"]}',
            {"summary": "string", "original_text": "string"},
            wrap="summary",
        ),
    )
}


def known_generators(chunks: DataFrame, generators: dict[str, Generator] = GENERATORS) -> DataFrame:
    """Rows whose generator is registered; others are skipped."""
    return chunks.filter(F.col("generator").isin(list(generators)))


def attach_completions(prompts: DataFrame, completions: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator")) -> DataFrame:
    """Prompts with their answers; null where the answer is still missing.

    The chunk number is part of the key, so the chunks of one huge document spread over tasks.
    """
    return prompts.join(completions, list(keys), "left")


def parse_json(raw: Column) -> Column:
    """The value of an answer. White space other than JSON's own is taken off only where the answer does not parse with it."""
    return let(strip_code_fence(raw), lambda answer: F.coalesce(F.try_parse_json(answer), F.try_parse_json(strip(answer))))


def _list_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def parse_items(value: Column, generator: Column, generators: dict[str, Generator] = GENERATORS) -> Column:
    """Items of a parsed answer: a list, a list under `items` or under a key of the generator (any
    generator's own name is one), or the object itself as the only item. A generator with `wrap`
    turns bare strings of its lists into objects with that field."""
    kind = F.schema_of_variant(value)
    # A name that is known only at run time has no fixed path.
    named = F.call_function("get_json_object", F.to_json(value), F.concat(F.lit("$['"), generator, F.lit("']")))
    found = F.when(~generator.isin(list(generators)), _list_at(F.try_parse_json(named), "$"))
    for g in generators.values():
        own = g.parse(value) if g.parse else F.coalesce(*[_list_at(value, f"$.{key}") for key in g.keys])
        found = F.when(generator == g.name, own).otherwise(found)
    listed = F.when(kind.startswith("ARRAY"), _list_at(value, "$")).when(
        kind.startswith("OBJECT"), F.coalesce(_list_at(value, "$.items"), found, F.array(value))
    )
    for g in generators.values():
        if g.wrap:
            listed = F.when(generator == g.name, _wrapped(listed, g.wrap)).otherwise(listed)
    return listed


def _wrapped(listed: Column, field: str) -> Column:
    def wrap(item: Column) -> Column:
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        return F.when(text.isNotNull(), F.parse_json(F.to_json(F.struct(text.alias(field))))).otherwise(item)

    return F.transform(listed, wrap)


def with_items(completions: DataFrame, raw: str = "raw", generators: dict[str, Generator] = GENERATORS) -> DataFrame:
    """Add `item_list`, and `reason` where an answer gives no items.

    The answer is parsed once per row: the parsed value is bound inside one expression, and `inline` gives its parts
    as columns, so that filters on them read the finished parts and do not parse the answer (and make it) again.
    """

    def judge(value: Column) -> Column:
        return let(parse_items(value, F.col("generator"), generators), lambda found: _verdict(F.col(raw), value, found))

    kept = [c for c in completions.columns if c not in ("item_list", "reason")]
    return completions.select(*kept, F.inline(F.array(let(parse_json(F.col(raw)), judge))))


def _verdict(raw: Column, value: Column, found: Column) -> Column:
    reason = (
        F.when(raw.isNull(), "pending")
        .when(value.isNull(), "not_json")
        .when(found.isNull(), "unexpected_type")
        .when(F.size(found) == 0, "empty")
    )
    return F.struct(found.alias("item_list"), reason.alias("reason"))


def explode_items(listed: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator"), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per item: keys, `item_no` within the answer, `item` as a variant."""
    return listed.select(*keys, *extra, F.posexplode("item_list").alias("item_no", "item"))


def rejects(listed: DataFrame, raw: str = "raw", keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator"), extra: tuple[str, ...] = ()) -> DataFrame:
    return listed.filter("reason IS NOT NULL").select(*keys, "reason", F.col(raw).alias("raw"), *extra)


def retry_requests(listed: DataFrame, attempt: str = "attempt", max_retries: int = 3, raw: str = "raw",
                   keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator"), generators: dict[str, Generator] = GENERATORS) -> DataFrame:
    """Prompts of a second pass over the answers that are not JSON and have attempts left."""
    schema = F.lit("")
    for g in generators.values():
        schema = F.when(F.col("generator") == g.name, g.schema).otherwise(schema)
    again = listed.filter((F.col("reason") == "not_json") & (F.col(attempt) < max_retries))
    previous = strip(strip_code_fence(F.col(raw)))
    return again.select(*keys, (F.col(attempt) + 1).alias("attempt"), retry_prompt(schema, previous).alias("prompt"))


def _field(g: Generator, field: str) -> Column:
    value = F.try_variant_get("item", f"$.{field}", g.fields[field])
    return F.coalesce(value, F.try_variant_get("item", "$", "string")) if field == g.wrap else value


def typed_items(items: DataFrame, generator: str, generators: dict[str, Generator] = GENERATORS) -> DataFrame:
    """Items of one generator with its own columns instead of the variant."""
    g = generators[generator]
    own = items.filter(F.col("generator") == generator)
    return own.select(*[c for c in own.columns if c != "item"], *[_field(g, f).alias(f) for f in g.fields])


def all_typed_items(items: DataFrame, generators: dict[str, Generator] = GENERATORS) -> DataFrame:
    """Items of all generators in one flat table, in one pass; fields of other kinds are null."""
    columns: dict[str, Column] = {}
    for g in generators.values():
        for f in g.fields:
            value = F.when(F.col("generator") == g.name, _field(g, f))
            columns[f] = F.coalesce(columns[f], value) if f in columns else value
    return items.select(*[c for c in items.columns if c != "item"], *[c.alias(f) for f, c in columns.items()])


def conversation_messages(items: DataFrame) -> DataFrame:
    """Conversations as messages; an item of `speaker` and `text` becomes a message of its own."""
    own = items.filter(F.col("generator") == "conversations")
    spoken = F.array(
        F.struct(
            F.try_variant_get("item", "$.speaker", "string").alias("role"),
            F.try_variant_get("item", "$.text", "string").alias("content"),
        )
    )
    messages = F.coalesce(
        F.try_variant_get("item", "$.messages", "array<struct<role:string,content:string>>"),
        F.when(F.try_variant_get("item", "$.text", "string").isNotNull(), spoken),
    )
    return own.withColumn("messages", messages).drop("item").filter("messages IS NOT NULL")


def tag_metadata(items: DataFrame, timestamp: Column) -> DataFrame:
    """Set `generator` and `timestamp` from the run unless the item brings its own."""
    return items.withColumns(
        {
            "item_generator": F.coalesce(F.try_variant_get("item", "$.generator", "string"), F.col("generator")),
            "item_timestamp": F.coalesce(F.try_variant_get("item", "$.timestamp", "string"), timestamp),
        }
    )


def merge_items(*parts: DataFrame) -> DataFrame:
    """Items from several runs or sources as one flat table. For generators of one run see
    `all_typed_items`, which reads the items once."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def override_union(text_items: DataFrame, media_items: DataFrame, media_keys: DataFrame, keys: tuple[str, ...] = ("doc_id", "generator")) -> DataFrame:
    """All media items, and the text items of keys media did not run for.

    `media_keys` holds every key media ran for, even when it produced nothing; it is made
    distinct first, so the anti join is many-to-one.
    """
    taken = media_keys.select(*keys).distinct()
    return text_items.join(taken, list(keys), "left_anti").unionByName(media_items, allowMissingColumns=True)


def items_by_generator(items: DataFrame) -> DataFrame:
    return items.groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("doc_id").alias("n_docs")
    )


def items_per_document(items: DataFrame, generators: list[str] = fixed.GENERATORS) -> DataFrame:
    """Wide form: a count per generator for each document (one aggregation, no pivot pass)."""
    counts = [F.count_if(F.col("generator") == g).alias(g) for g in generators]
    return items.groupBy("doc_id").agg(*counts)


def item_stats(items: DataFrame) -> DataFrame:
    """Count and mean serialised length."""
    return items.agg(
        F.count(F.lit(1)).alias("n_items"), F.coalesce(F.avg(F.length(F.to_json("item"))), F.lit(0.0)).alias("avg_length")
    )


def csv_header(items: DataFrame) -> DataFrame:
    """Field names of the items of each generator: distinct rows of (generator, field)."""
    fields = F.json_object_keys(F.to_json("item"))
    return items.select("generator", F.explode(fields).alias("field")).distinct()


def item_schemas(items: DataFrame, generators: list[str]) -> dict[str, tuple[StructType, bool]]:
    """Per generator the fields of its items with the type that holds all their values, and whether some
    items are no objects.

    One mergeable aggregate over all items, combined before its row per generator reaches the driver.
    Numbers with a fraction are doubles; lists, objects and fields of mixed types are strings, which hold
    their JSON. A generator without items has no fields.
    """
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    found = items.filter(F.col("generator").isin(generators)).groupBy("generator").agg(
        F.schema_of_variant_agg(F.when(is_object, F.col("item"))).alias("schema"), F.max(~is_object).alias("loose")
    )
    out = dict.fromkeys(generators, (StructType(), False))
    return out | {r["generator"]: (_plain_fields(r["schema"]), bool(r["loose"])) for r in found.collect()}


def _plain_fields(schema: str) -> StructType:
    """The top fields of an aggregated schema, each with a type that a CSV column can have."""
    if not schema.startswith("OBJECT"):
        return StructType()
    # Names in backticks stay as they are.
    ddl = "".join(part if part.startswith("`") else part.replace("OBJECT<", "STRUCT<") for part in re.findall(r"`(?:[^`]|``)*`|[^`]+", schema))
    plain = {"long": LongType(), "double": DoubleType(), "float": DoubleType(), "decimal": DoubleType(), "boolean": BooleanType()}
    whole = StructType.fromDDL(f"item {ddl}")["item"].dataType
    return StructType([StructField(f.name, plain.get(f.dataType.typeName(), StringType())) for f in whole])


def typed_columns(items: DataFrame, generator: str, schema: StructType, loose: bool = False,
                  keys: tuple[str, ...] = ("doc_id", "chunk_id", "item_no")) -> DataFrame:
    """The items of a generator with a column per field of `schema` (see `item_schemas`).

    A field named like a key becomes `item.<name>`; with `loose`, items that are no objects keep their text
    in a column `item`.
    """
    named = [F.col("_item").getField(f.name).alias(f"item.{f.name}" if f.name in (*keys, "item") else f.name) for f in schema]
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    text = [F.when(~is_object, F.try_variant_get("item", "$", "string")).alias("item")] if loose else []
    own = items.filter(F.col("generator") == generator)
    values = own.withColumn("_item", F.from_json(F.to_json("item"), schema)) if named else own
    return values.select(*keys, *named, *text)


def sample_items(items: DataFrame, key: Column, n: int = fixed.SAMPLE_ITEMS, seed: int | None = 0) -> DataFrame:
    """`n` items: the first by `key`, or with a seed a repeatable random choice."""
    order = key if seed is None else F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return items.orderBy(order, key).limit(n)


def complete(
    prompts: DataFrame,
    call: Callable[..., str],
    max_retries: int = 3,
    backoff: float = 1.0,
    concurrency: int = 8,
    keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator"),
    media: str | None = None,
    fallback: Callable[..., str] | None = None,
) -> DataFrame:
    """Run the user's completion function over the prompts, `concurrency` calls at a time.

    `call` gets the prompt and, with a `media` column, the media path too. `fallback` is asked
    once when `call` keeps failing; if that fails as well, the row has `error` instead of `raw`.
    Write the result to a table before using it: calls cost money and must not run again when a
    later stage is recomputed.
    """
    import time

    asked = [*keys, "prompt", *([media] if media else [])]
    kept = prompts.select(*asked)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keys]

    def ask(*arguments) -> tuple[str | None, str | None, int]:
        error, tries = None, [call] * max_retries + ([fallback] if fallback else [])
        for attempt, function in enumerate(tries, 1):
            try:
                return function(*arguments), None, attempt
            except Exception as exc:  # one bad call must not end the task
                error = str(exc)
                if attempt < len(tries):
                    time.sleep(backoff)
        return None, error, len(tries)

    def run(batches):
        for batch in batches:
            columns = [batch[c] for c in asked[len(keys):]]
            answers = [ask(*row) for row in zip(*columns)]
            raw, error, calls = zip(*answers) if answers else ((), (), ())
            yield batch[list(keys)].assign(raw=list(raw), error=list(error), calls=list(calls))

    schema = ", ".join([*fields, "raw string", "error string", "calls int"])
    return kept.repartition(concurrency, *keys).mapInPandas(run, schema)


def echo(prompt: str, *media: str) -> str:
    """A stand-in completion function for trials without a service."""
    return fixed.ECHO_ANSWER.format(prompt=prompt[:50])


ANSWER_LOG = "hash string, raw string, error string, calls int"


def complete_logged(
    prompts: DataFrame,
    call: Callable[..., str],
    log: str,
    max_retries: int = 3,
    backoff: float = 1.0,
    concurrency: int = 8,
    in_flight: int = 4,
    commit: int = 16,
    keys: tuple[str, ...] = ("doc_id", "chunk_id", "generator"),
    fallback: Callable[..., str] | None = None,
) -> DataFrame:
    """`complete` with an answer log in the folder `log`, so that no answered prompt is paid for twice.

    Each task keeps at most `in_flight` calls under way and writes every `commit` answers to the log as
    one file that appears whole, before it goes on. A task that is tried again, a stage that is run
    again and a later run all ask the log first: prompts whose hash it knows an answer for are joined to it
    and never reach `call`, and a retried task reads what its earlier attempts have left in its own part of the log.
    At most `commit` + `in_flight` answers of a task that dies are paid for again. Failures (`error`) are not
    logged and are asked again by the next run. Equal prompts of one run are asked once per row.
    Null prompts are not asked: their answer is null.
    """
    import json
    import time
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd
    from pyarrow import fs
    from pyspark.taskcontext import TaskContext

    from corpusforge.sinks.committed import open_folder, put_whole

    spark = prompts.sparkSession
    asked = prompts.select(*keys, "prompt").withColumn("hash", F.sha2("prompt", 256))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name in keys)
    system, root = open_folder(log)
    known = spark.createDataFrame([], ANSWER_LOG)
    if system.get_file_info(root).type == fs.FileType.Directory:
        known = spark.read.schema(ANSWER_LOG).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(log).dropDuplicates(["hash"])

    def ask(prompt: str) -> tuple[str | None, str | None, int]:
        error, tries = None, [call] * max_retries + ([fallback] if fallback else [])
        for attempt, function in enumerate(tries, 1):
            try:
                return function(prompt), None, attempt
            except Exception as exc:  # one bad call must not end the task
                error = str(exc)
                if attempt < len(tries):
                    time.sleep(backoff)
        return None, error, len(tries)

    def run(batches):
        files, base = open_folder(log)
        part = TaskContext.get().partitionId()
        own = f"{base}/part-{part:06d}"
        files.create_dir(own, recursive=True)
        answered = {}
        # Only what another attempt of this very task can have left since the plan was made.
        for found in files.get_file_info(fs.FileSelector(own)):
            if found.base_name.endswith(".jsonl"):
                with files.open_input_stream(found.path) as source:
                    answered |= {a["hash"]: (a["raw"], None, a["calls"]) for a in map(json.loads, source.read().splitlines())}
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for start in range(0, len(batch), commit):
                    rows = batch.iloc[start : start + commit]
                    waiting = {h: pool.submit(ask, p) for h, p in zip(rows["hash"], rows["prompt"]) if h is not None and h not in answered}
                    fresh = {h: f.result() for h, f in waiting.items()}
                    good = [json.dumps({"hash": h, "raw": raw, "calls": calls}, ensure_ascii=False) for h, (raw, error, calls) in fresh.items() if error is None]
                    if good:
                        put_whole(files, f"{own}/{uuid.uuid4().hex}.jsonl", ("\n".join(good) + "\n").encode())
                    answers = [(answered | fresh).get(h, (None, None, 0)) for h in rows["hash"]]
                    raw, error, calls = zip(*answers)
                    yield pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "raw": list(raw), "error": list(error), "calls": list(calls)})

    schema = ", ".join([fields, "raw string", "error string", "calls int"])
    fresh = asked.join(known.select("hash"), "hash", "left_anti").repartition(concurrency, *keys).mapInPandas(run, schema)
    old = asked.join(known, "hash").select(*keys, "raw", F.lit(None).cast("string").alias("error"), "calls")
    return fresh.unionByName(old)
