"""Run registered queries beside their SQL on one scale and compare names, kinds of type and values.

Usage: python tools/check_oracle.py SF_DIR [query or module:NAME ...]
"""
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from waymesh.catalog import all_oracles, all_queries  # noqa: E402
from waymesh.catalog.registry import _QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(text):
    text = str(text).lower()
    for name, words in {"int": ("int", "long", "short"), "float": ("double", "float"), "dec": ("decimal",),
                        "str": ("varchar", "string"), "bool": ("bool",), "ts": ("timestamp",)}.items():
        if any(w in text for w in words):
            return ("huge" if "huge" in text else "big" if "big" in text else "") + name
    return text


def main():
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles = all_queries(), all_oracles()
    if wanted:
        names = [n for n in queries if n in wanted or f"module:{_QUERIES[n].__module__.split('.')[-1]}" in wanted]
    else:
        names = list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.collect()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(error)[:500]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            cur = con.execute(oracles[name])
            names_sql = [d[0] for d in cur.description]
            types_sql = [str(d[1]) for d in cur.description]
            want = cur.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: sql {str(error)[:500]}", flush=True)
            continue
        sql_took = time.time() - start
        a, b = rows_of(got, df.columns), rows_of(want, names_sql)
        problem = ""
        if sorted(df.columns) != sorted(names_sql):
            problem = f"columns {sorted(df.columns)} vs {sorted(names_sql)}"
        elif a != b:
            diff = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
            problem = f"values {len(a)} vs {len(b)} rows {diff}"
        kinds = [(c, kind(t), kind(dict(zip(names_sql, types_sql)).get(c))) for c, t in df.dtypes]
        warn = [k for k in kinds if k[1] != k[2]]
        if problem:
            bad += 1
            print(f"FAIL  {name}: {problem[:1200]}", flush=True)
        else:
            print(f"ok    {name}: {len(a)} rows spark {took:.1f}s sql {sql_took:.1f}s"
                  + (f"  types {warn}" if warn else "") + ("  EMPTY" if not a else ""), flush=True)
    print(f"{len(names)} run, {bad} bad")
    spark.stop()
    sys.exit(1 if bad else 0)


main()
