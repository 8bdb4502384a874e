"""Compare registered queries with their SQL: values, names and types of all columns.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def difference(df, relation) -> str | None:
    """None when both hold the same rows, else a short account."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} against {sorted(relation.columns)}"
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), "?") for f in df.schema}
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    wrong = {n: (spark_types[n], sql_types[n]) for n in names if spark_types[n] != sql_types[n]}
    if wrong:
        return f"types {wrong}"
    order = ", ".join(f'"{n}"' for n in names)
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    theirs = sorted(relation.project(order).fetchall(), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            n = sum(x != y for x, y in zip(ours, theirs))
            return f"{n} rows differ, first {dict(zip(names, a))} against {dict(zip(names, b))}"
    return None


def main() -> None:
    from bench import session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = session()
    connection = oracle_connection(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name not in oracle:
                result = f"no SQL, {df.count()} rows"
                if df.count() < 20:
                    result += f" {[r.asDict() for r in df.collect()]}"
            else:
                built = time.time()
                result = difference(df, connection.sql(oracle[name]))
                failed += result is not None
        except Exception as error:  # report and go on with the next query
            result, failed = f"{type(error).__name__}: {str(error)[:400]}", failed + 1
        print(f"{name}: {result or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} of {len(names)} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
