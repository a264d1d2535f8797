"""Keyed permutations: bijections that follow the seed and not the partitions."""

import hashlib

import duckdb

from cloudloom import queries as core
from cloudloom.plans.order import permutation


def test_permutation_is_a_bijection_set_by_ids_and_seed(spark):
    for n in (0, 1, 7, 1000):
        rows = spark.range(n)
        got = {r["id"]: r["place"] for r in permutation(rows, "id", seed=3).collect()}
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
        assert got == {i: at for at, i in enumerate(order)}
        assert got == {r["id"]: r["place"] for r in permutation(rows.repartition(5), "id", seed=3).collect()}
    assert got != {r["id"]: r["place"] for r in permutation(rows, "id", seed=4).collect()}


def test_permutation_with_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, place_of string")
    got = permutation(rows, "id").collect()
    assert sorted(r["place"] for r in got) == [0, 1, 2, 3]
    assert {r["place_of"] for r in got} == {"a", "b", "c", "d"}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = duckdb.sql(core.SQL["permutation"]).fetchall()
    assert sorted(tuple(r) for r in core.QUERIES["permutation"](spark, sf).select("event_id", "place").collect()) == sorted(want)
