"""Compares a registered query with its SQL on the generated tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, data=DATA):
    db = duckdb.connect()
    for t in TABLES:
        path = Path(data, f"{t}.parquet")
        if path.exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found, want = query(spark, str(data)), db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, want.fetchall())


def started(spark, request, queries, sql, threads=5):
    """For a module's fixture: {name: future of compare()} for the queries whose tests were selected, some at a time.

    On small tables a query waits for its many short jobs more than it works.
    """
    wanted = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.fspath and hasattr(i, "callspec")]
    with ThreadPoolExecutor(threads) as pool:
        yield {name: pool.submit(compare, spark, queries[name], sql[name]) for name in wanted}
