"""Compares registered queries with their SQL: python tests/oracle.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else bytes(value) if isinstance(value, bytearray) else value


def difference(df, con, sql: str) -> str:
    """Empty if the rows are equal."""
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    cur = con.execute(sql)
    have = [x[0] for x in cur.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    want = sorted(repr(tuple(plain(r[have.index(c)]) for c in names)) for r in cur.fetchall())
    if got == want:
        return ""
    only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only in Spark {only[0]}; only by SQL {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf, only = (sys.argv[1:2] or ["/root/testdata/sf0.01"])[0], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql = duck(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if (only and name not in only) or (not only and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = difference(f(spark, sf), con, sql[name]) if name in sql else f"rows only: {f(spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:400]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
