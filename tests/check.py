"""Run registered queries next to their oracle SQL and compare all rows.

    python tests/check.py [sf_dir] [query …]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return "NULL" if value is None else str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = [f"{n}: {t} vs {types.get(n)}" for n, t in df.dtypes if SAME_TYPE.get(t) != types.get(n)]
    if odd and ours[0] == theirs[0]:
        return f"types {odd}"
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if ours[1] == theirs[1]:
        return None if ours[1] else "no rows"
    only_ours, only_theirs = sorted(set(ours[1]) - set(theirs[1])), sorted(set(theirs[1]) - set(ours[1]))
    return (f"{len(ours[1])} vs {len(theirs[1])} rows; columns {ours[0]}\n   spark: "
            f"{[str(x)[:700] for x in only_ours[:2]]}\n   oracle: {[str(x)[:700] for x in only_theirs[:2]]}")


def main() -> None:
    import __spark_entry__ as entry
    from rolefold.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                             "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
