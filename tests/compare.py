"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

As a script: python tests/compare.py [scale folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str, query, sql: str | None) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours = dict(df.dtypes)
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    wrong = [(c[0], str(c[1]), ours[c[0]]) for c in answer.description if kinds.get(str(c[1])) != ours[c[0]]]
    want = _rows(columns, answer.fetchall())
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from corpusforge.session import build_session

    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = difference(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}"[:1200], flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
