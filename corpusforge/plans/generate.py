"""From documents to training items with the user's completion function."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.chunking import drop_blank_docs, explode_chunks, fan_out
from corpusforge.operators.items import GENERATORS, Generator, complete, explode_items, override_union, rejects, retry_requests, with_items
from corpusforge.plans.corpus import prompts_of, templates_of
from corpusforge.session import discard, materialize, shared_dir
from corpusforge.settings import Settings

KEYS = ("doc_id", "chunk_id", "generator")
#: Bytes of prompts one task of a round asks, about.
TASK_BYTES = 1 << 28


def text_prompts(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A prompt for each chunk and text generator; custom prompts replace the style as a whole."""
    chunks = explode_chunks(drop_blank_docs(documents), keep=["doc_id"], size=settings.chunk_size, overlap=settings.overlap)
    return prompts_of(chunks, templates_of(settings)).select(*KEYS, "prompt")


def media_prompts(media: DataFrame, templates: dict[str, str]) -> DataFrame:
    """A prompt for each media file (`doc_id`, `media_path`) and media generator."""
    whole = media.select("doc_id", F.lit(0).alias("chunk_id"), "media_path")
    return fan_out(whole, templates).select(*KEYS, "media_path", F.col("template").alias("prompt"))


def answered(prompts: DataFrame, call: Callable[..., str], attempt: int, concurrency: int = 8, **calling) -> DataFrame:
    """The answers of one round, written down.

    `concurrency` calls at a time means as many tasks at a time, so prompts of more than `TASK_BYTES` a task are
    dealt into waves, each a table of its own that is asked when the one before it is done.
    """
    media = [calling["media"]] if calling.get("media") else []
    asked = prompts.select(*KEYS, "prompt", *media)
    size = asked.agg(F.sum(F.octet_length("prompt"))).first()[0] or 0
    waves = max(1, -(-size // (concurrency * TASK_BYTES)))

    def answers(some: DataFrame) -> DataFrame:
        return complete(some, call, keys=KEYS, concurrency=concurrency, **calling).withColumn("attempt", F.lit(attempt))

    if waves == 1:
        return materialize(answers(asked), "answers")
    wave = F.floor(F.spark_partition_id() / concurrency).cast("int")
    dealt = materialize(asked.repartition(waves * concurrency, *KEYS).withColumn("_wave", wave), "prompts")
    path = f"{shared_dir(prompts.sparkSession)}/answers-{uuid.uuid4().hex}"
    for number in range(waves):
        # Files of other waves are passed over by their statistics.
        found = answers(dealt.filter(F.col("_wave") == number))
        found.write.option("compression", "zstd").mode("append").parquet(path)
    discard(dealt)
    return prompts.sparkSession.read.schema(found.schema).parquet(path)


def generate(prompts: DataFrame, call: Callable[..., str], rounds: int = 3, generators: dict[str, Generator] = GENERATORS,
             **calling) -> tuple[DataFrame, DataFrame]:
    """Items and rejects of all prompts.

    Each round's answers are written down before they are parsed, so no call is ever repeated;
    answers that are not JSON are asked again, with the answer quoted, for up to `rounds` rounds.
    A call that failed after all its tries is rejected as `call_failed`, with its error and calls.
    """
    items, rejected = None, None
    asked = prompts
    for attempt in range(1, rounds + 1):
        answers = answered(asked, call, attempt, **calling)
        failed = F.col("raw").isNull() & F.col("error").isNotNull()
        listed = with_items(answers, generators=generators).withColumn("reason", F.when(failed, "call_failed").otherwise(F.col("reason")))
        again = retry_requests(listed, max_retries=rounds, keys=KEYS, generators=generators)
        final = listed.filter("reason IS NOT NULL") if attempt == rounds else listed.filter("reason <> 'not_json'")
        found, lost = explode_items(listed.filter("reason IS NULL"), KEYS), rejects(final, keys=KEYS, extra=("error", "calls"))
        items = found if items is None else items.unionByName(found)
        rejected = lost if rejected is None else rejected.unionByName(lost)
        if calling.get("media"):
            again = again.join(prompts.select(*KEYS, calling["media"]), list(KEYS))
        asked = again.drop("attempt")
    return items, rejected


def generate_full(documents: DataFrame, media: DataFrame, templates: dict[str, str], call: Callable[..., str],
                  settings: Settings = Settings(), **calling) -> tuple[DataFrame, DataFrame]:
    """Items and rejects of documents and their media (`doc_id`, `media_path`) together.

    Where a media generator of `templates` has run for a document, its items replace that document's text items of the
    same generator, even if it gave none. `call` gets the prompt, and for media the path too.
    """
    prompts = media_prompts(media, templates)
    found, lost = generate(text_prompts(documents, settings), call, **calling)
    seen, unseen = generate(prompts, call, media="media_path", **calling)
    return override_union(found, seen, prompts), lost.unionByName(unseen)
