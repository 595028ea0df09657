"""Run the queries next to their SQL and compare rows: python tests/oracle.py SF [name part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        text = v.isoformat().replace("T", " ")
        return text if len(text) > 10 else text + " 00:00:00"
    return str(v)


def kind(type_name: str) -> str:
    t = type_name.lower()
    for k, names in {
        "int": ("bigint", "int", "integer", "smallint", "hugeint", "tinyint", "ubigint"), "float": ("double", "float"),
        "text": ("string", "varchar"), "bool": ("boolean",), "time": ("timestamp", "timestamp with time zone", "timestamp_ntz"), "date": ("date",),
    }.items():
        if t in names:
            return k + ("64" if t in ("bigint", "hugeint") else "")
    return t


def compare(spark, con, name, query, sql, sf):
    t0 = time.time()
    df = query(spark, sf)
    rows = df.collect()
    took = time.time() - t0
    names = sorted(df.columns)
    if sql is None:
        return "ROWS", f"{len(rows)} rows", took
    t0 = time.time()
    res = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in res.description}
    other = res.fetchall()
    dtook = time.time() - t0
    cols = [d[0] for d in res.description]
    if sorted(cols) != names:
        return "COLUMNS", f"{names} / {sorted(cols)}", took
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = {c: (types[c], desc[c]) for c in names if kind(types[c]) != kind(desc[c])}
    a = sorted("|".join(_cell(r[c]) for c in names) for r in rows)
    at = {c: i for i, c in enumerate(cols)}
    b = sorted("|".join(_cell(r[at[c]]) for c in names) for r in other)
    if a != b:
        sa, sb = set(a), set(b)
        return "VALUES", f"{len(a)} / {len(b)} rows; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}", took
    if bad:
        return "TYPES", str(bad), took
    return "OK" if a else "EMPTY", f"{len(a)} rows (sql {dtook:.1f}s)", took


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sql = entry.oracle_sql()
    total, good = 0, 0
    for name, q in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        total += 1
        try:
            status, note, took = compare(spark, con, name, q, sql.get(name), sf)
        except Exception as e:  # noqa: BLE001
            status, note, took = "ERROR", str(e).split("JVM stacktrace")[0][:1500], 0
        good += status in ("OK", "ROWS")
        print(f"{status:8} {name:40} {took:6.2f}s  {note}", flush=True)
    print(f"{good}/{total} good")


if __name__ == "__main__":
    main()
