"""Paid calls with an answer log: no answered prompt is asked again."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.operators.items import complete_logged

KEYS = ("doc_id", "chunk_id", "generator")


def prompts(spark, n):
    return spark.range(0, n, 1, 2).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.lit("g").alias("generator"), F.concat(F.lit("prompt \"\n"), "id").alias("prompt"))


def asker(folder, die_at=None):
    """Notes each call in a file; the worker that gets `die_at` dies once."""

    def call(prompt):
        number = int(prompt.split("\n")[1])
        if number == die_at and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        with open(f"{folder}/calls", "a") as out:
            out.write(f"{number}\n")
        return f"answer é \"{number}\"\nend"

    return call


def test_a_killed_task_pays_each_answer_once(spark, tmp_path):
    log, call = str(tmp_path / "log"), asker(str(tmp_path), die_at=37)
    options = dict(concurrency=1, in_flight=1, commit=4, backoff=0.0)
    with pytest.raises(Exception, match="worker exited|crashed"):
        complete_logged(prompts(spark, 60), call, log, **options).collect()
    before = Counter(open(tmp_path / "calls").read().split())
    assert 0 < len(before) < 60 and set(before.values()) == {1}
    rows = complete_logged(prompts(spark, 60), call, log, **options).collect()
    assert {r["doc_id"]: r["raw"] for r in rows} == {i: f'answer é "{i}"\nend' for i in range(60)} and all(r["error"] is None for r in rows)
    calls = Counter(open(tmp_path / "calls").read().split())
    assert len(calls) == 60 and sum(calls.values()) <= 60 + 4
    assert len(complete_logged(prompts(spark, 60), call, log, concurrency=3).collect()) == 60
    assert Counter(open(tmp_path / "calls").read().split()) == calls


def test_failures_are_asked_again_and_nulls_never(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)

    def fails(prompt):
        if not os.path.exists(f"{folder}/ready") and prompt.endswith("3"):
            raise RuntimeError("busy")
        return prompt.upper()

    some = prompts(spark, 5).withColumn("prompt", F.when(F.col("doc_id") != 1, F.col("prompt")))
    rows = {r["doc_id"]: r for r in complete_logged(some, fails, log, max_retries=2, backoff=0.0).collect()}
    assert rows[3]["error"] == "busy" and rows[3]["calls"] == 2 and rows[3]["raw"] is None and rows[1]["raw"] is None and rows[1]["calls"] == 0
    open(f"{folder}/ready", "w").close()
    rows = {r["doc_id"]: r for r in complete_logged(some, fails, log, max_retries=2, backoff=0.0).collect()}
    assert rows[3]["raw"] == 'PROMPT "\n3' and rows[3]["error"] is None and len(rows) == 5
    assert complete_logged(some.limit(0), fails, log).collect() == []
