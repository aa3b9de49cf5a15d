"""Runs queries and their SQL side by side: ``python tests/oracle.py sf0.01 [name...]``."""

from __future__ import annotations

import decimal
import math
import sys
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}" if not float(x).is_integer() else str(int(x))
    if isinstance(x, bool):
        return str(x)
    return str(x).removesuffix(" 00:00:00").removesuffix("+00:00")


def rows(names: list[str], data: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows; else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = rows([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return f"{len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a, key=str)[:2]}, only there {sorted(b, key=str)[:2]}"
    return "no rows" if not mine[1] else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    where = f"/root/testdata/{sys.argv[1]}"
    con = connect(where)
    for name, sql in entry.oracle_sql().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            try:
                said = compare(session, con, entry.queries()[name], sql, where)
            except Exception as e:
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(name, "ok" if not said else said, flush=True)
