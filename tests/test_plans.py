"""What the physical plans of the queries must and must not hold."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, SMALL)) for name, query in entry.queries().items()}


def test_no_cross_joins_and_no_python(plans):
    for name, text in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "PythonUDF"):
            assert bad not in text, (name, bad)


def test_row_local_work_does_not_shuffle(spark):
    """These are scan and project only, at every size."""
    for name in ("text_quality", "clean_text", "chunk_default", "chunk_paragraph", "prompt_fanout", "page_analysis", "nearby_text", "html_text"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SMALL)), name


def test_only_needed_columns_are_read(spark):
    for name, columns in (("chunk_default", "doc_id:bigint,text:string"), ("slowest_files", "doc_id:bigint,source:string,n_chars:bigint"), ("page_range", "conv_id:bigint,turn:bigint,text:string")):
        shown = plan(entry.queries()[name](spark, SMALL))
        assert f"ReadSchema: struct<{columns}>" in shown, name


def test_filters_reach_the_scan(spark):
    from corpusforge.operators.quality import page_filter

    pages = spark.read.parquet(f"{SMALL}/conversations.parquet").withColumnRenamed("turn", "page_num")
    shown = plan(page_filter(pages, 2, 5))
    assert "GreaterThanOrEqual(turn,2)" in shown and "LessThanOrEqual(turn,5)" in shown


def test_top_n_is_not_a_full_sort(plans):
    for name in ("first_files", "slowest_files", "recent_errors", "sample_items"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_windows_are_split_into_parts(plans):
    """Running values work on parts of the order; only the table of parts is put in one place."""
    for name in ("file_batches", "run_progress", "auto_stop_limits"):
        assert "_part" in plans[name], name


def test_retention_orders_nothing(plans):
    """The cut is selected by histograms; the verdict compares each row with it."""
    for step in ("rangepartitioning", "Window", "Sort ["):
        assert step not in plans["retention"], step


def test_auto_stop_moves_rows_once(spark):
    from corpusforge.operators import runs
    from corpusforge.plans import derived

    log = derived.run_log_of(spark.read.parquet(f"{SMALL}/documents.parquet")).select("seq", "success", "seconds", "error")
    shown = plan(runs.stopping_segment(log, max_files=40, max_seconds=600))
    assert sum(line.strip(" +-:").startswith("Exchange") for line in shown.splitlines()) == 2, shown
    assert "rangepartitioning" not in shown


def parses(df):
    """How often the optimised plan names the JSON parser."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_answers_are_parsed_once(spark):
    from corpusforge.operators import items
    from corpusforge.plans import queries

    listed = items.with_items(queries._answers(spark, SMALL))
    once = str(items.with_items(spark.createDataFrame([], "generator string, raw string"))._jdf.queryExecution().analyzed()).count("parse_json")
    assert once > 0 and parses(items.explode_items(listed)) == parses(items.rejects(listed)) == once
    for name in ("items_merged", "items_override", "tagged_items", "item_stats", "csv_header", "items_per_document", "items_by_generator", "parse_completions"):
        assert parses(queries.QUERIES[name](spark, SMALL)) == once, name


def test_answers_quote_their_chunk_once(spark):
    from corpusforge.plans import queries

    shown = queries._answers(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("StructsToJson") == 1


def test_rendering_parses_before_it_numbers(spark, monkeypatch):
    from corpusforge.plans import queries

    given = []
    number = queries.render.number_items
    monkeypatch.setattr(queries.render, "number_items", lambda rows, *more: given.append(parses(rows)) or number(rows, *more))
    queries.QUERIES["render_json"](spark, SMALL)
    assert given == [0]
