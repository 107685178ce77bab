"""Compare registered queries with their DuckDB SQL: names, row counts and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if not isinstance(value, (list, tuple, dict)) else repr(value)


def _table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, function, sql: str, sf_dir: str) -> list[str]:
    df = function(spark, sf_dir)
    ours = _table(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = _table(names, result.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    for field in df.schema:
        spark_kind, kind = field.dataType.simpleString(), kinds.get(field.name, "")
        expected = {"bigint": ("BIGINT",), "string": ("VARCHAR", "JSON"), "double": ("DOUBLE",), "boolean": ("BOOLEAN",)}
        if kind not in expected.get(spark_kind, (kind,)) and kind != '"NULL"':
            out.append(f"type of {field.name}: {spark_kind} and {kind}")
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows, expected {len(theirs)}")
    if ours != theirs:
        extra, missing = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
        out.append(f"{len(extra)} extra, {len(missing)} missing: {str(extra[:2])[:500]} / {str(missing[:2])[:500]}")
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = differences(spark, con, function, sqls[name], sf_dir)
            else:
                problems = [] if function(spark, sf_dir).count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        kind = "sql " if name in sqls else "rows"
        print(f"{'BAD' if problems else 'ok '} {kind} {name} {time.time() - start:.1f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("bad:", bad, "of", len(wanted or entry.queries()), "without sql:", sorted(set(entry.queries()) - set(sqls)))
