"""Randomised checks of the PostgreSQL-style AGE parts against DuckDB's age()."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from ledgerlens.functions import age_months, age_parts


def _pairs(n=2000, seed=11):
    rnd = random.Random(seed)
    base = datetime(2000, 1, 1)
    out = []
    for _ in range(n):
        b = base + timedelta(days=rnd.randint(0, 9000), seconds=rnd.choice([0, rnd.randint(0, 86399)]))
        a = b + timedelta(days=rnd.choice([0, 1, 27, 28, 29, 30, 31, rnd.randint(0, 4000)]),
                          seconds=rnd.choice([0, -1, 1, rnd.randint(-86399, 86399)]))
        if a < b:
            a, b = b, a
        out.append((a, b))
    # Month-end cases where months_between and AGE disagree.
    out += [(datetime(2021, 2, 28), datetime(2021, 1, 31)), (datetime(2021, 3, 1), datetime(2021, 1, 31)),
            (datetime(2020, 2, 29), datetime(2019, 2, 28)), (datetime(2021, 4, 30, 12), datetime(2021, 3, 31, 13))]
    return out


def test_age_parts_match_duckdb_for_later_first(spark):
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    years, months = age_parts(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select("a", "b", years, months).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    want = con.execute("SELECT a, b, date_part('year', age(a, b)), date_part('month', age(a, b)) FROM p").fetchall()
    assert sorted(got) == sorted(want)


def test_age_is_antisymmetric_in_months(spark):
    pairs = _pairs(300, seed=5)
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    rows = df.select(age_months(F.col("a"), F.col("b")).alias("x"),
                     age_months(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r.x == -r.y for r in rows)
