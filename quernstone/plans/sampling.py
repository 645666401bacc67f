"""Repeatable samples of orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.keys import hash_threshold
from quernstone.operators.sampling import (
    hash_sample,
    hash_sample_by,
    nested_samples,
    random_sample_by,
    stratified_sample,
)
from quernstone.plans.registry import Plans, micros, table
from quernstone.sources.tables import read_nested, read_rate, write_nested, write_rates
from quernstone.support.cut import scratch_path

PLANS = Plans()

SEED = 7
# The sample rates in percent, coarse and fine.
COARSE_RATES = list(range(5, 96, 10))
FINE_RATES = list(range(1, 16))


def hash_sql(*key: str) -> str:
    """SQL of the hash that orders rows."""
    parts = [
        f"coalesce(length(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR), '-')" for k in key
    ]
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


# Whole rows of orders, the date as microseconds.
_COLUMNS = """
    o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, date_us, stratum
"""
_RANKED = f"""
    placed AS (
        SELECT *, epoch_us(o_orderdate) AS date_us, CAST(year(o_orderdate) AS INTEGER) AS stratum
        FROM orders
    ),
    ranked AS (
        SELECT *,
               row_number() OVER (PARTITION BY stratum ORDER BY {hash_sql("o_orderkey")}) AS rn,
               count(*) OVER (PARTITION BY stratum) AS n
        FROM placed
    )
"""


def _orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    more = [micros("o_orderdate").alias("date_us"), F.year("o_orderdate").alias("stratum")]
    return rows.select("*", *more).drop("o_orderdate")


def _sample_sql(percent: int) -> str:
    return f"WITH {_RANKED} SELECT {_COLUMNS} FROM ranked WHERE rn * 100 < {percent} * n + 100"


@PLANS.add(_sample_sql(5))
def stratified_sample_exact(spark, sf_dir):
    return stratified_sample(_orders(spark, sf_dir), ["stratum"], ["o_orderkey"], 5, SEED)


@PLANS.add(_sample_sql(15))
def stratified_sample_spread(spark, sf_dir):
    """The same without a broadcast, as for more strata than fit one, and sliced to the end."""
    return stratified_sample(
        _orders(spark, sf_dir),
        ["stratum"],
        ["o_orderkey"],
        15,
        SEED,
        slice_rows=0,
        broadcast_rows=0,
    )


def _nested_sql(rates: list[int]) -> str:
    cases = " ".join(f"WHEN rn * 100 < {p} * n + 100 THEN {p}" for p in rates)
    return f"""
        WITH {_RANKED}, rated AS (
            SELECT {_COLUMNS}, CAST(CASE {cases} END AS INTEGER) AS first_rate FROM ranked
        )
        SELECT * FROM rated WHERE first_rate IS NOT NULL
    """


@PLANS.add(_nested_sql(COARSE_RATES))
def nested_samples_coarse(spark, sf_dir):
    return nested_samples(
        _orders(spark, sf_dir), ["stratum"], ["o_orderkey"], COARSE_RATES, SEED
    )


@PLANS.add(_nested_sql(FINE_RATES))
def nested_samples_fine(spark, sf_dir):
    return nested_samples(_orders(spark, sf_dir), ["stratum"], ["o_orderkey"], FINE_RATES, SEED)


@PLANS.add(_sample_sql(25))
def nested_sample_read_back(spark, sf_dir):
    """One rate read from the whole family written once."""
    nested = nested_samples(
        _orders(spark, sf_dir), ["stratum"], ["o_orderkey"], COARSE_RATES, SEED
    )
    path = scratch_path(spark, "nested")
    write_nested(nested, path)
    return read_nested(spark, path, 25)


@PLANS.add(_sample_sql(15))
def rate_directories(spark, sf_dir):
    """A table per rate written from one family, one of them read back."""
    nested = nested_samples(_orders(spark, sf_dir), ["stratum"], ["o_orderkey"], [5, 15, 25], SEED)
    base = scratch_path(spark, "rates")
    write_rates(nested, base, [5, 15, 25])
    return read_rate(spark, base, 15)


_MARKED = """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_linenumber % 3 > 0 THEN concat(l_returnflag, '|', l_linestatus) END AS flags
    FROM lineitem
"""
_FLAG_KEY = hash_sql("flags", "l_partkey")


@PLANS.add(
    f"""
    WITH keyed AS (SELECT *, {_FLAG_KEY} AS h, l_linenumber % 2 AS stratum FROM ({_MARKED})),
    cuts AS (
        SELECT stratum, h AS cut FROM (
            SELECT stratum, h, count(*) OVER (PARTITION BY stratum) AS n,
                   row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn
            FROM keyed
        ) WHERE rn = (20 * n + 99) // 100
    )
    SELECT l_orderkey, l_linenumber, l_partkey, flags, CAST(stratum AS INTEGER) AS stratum
    FROM keyed JOIN cuts USING (stratum) WHERE h <= cut
    """
)
def stratified_sample_two_keys(spark, sf_dir):
    """A key of two columns with separators and nulls in it; rows that share a key stay together."""
    flags = F.when(F.col("l_linenumber") % 3 > 0, F.concat_ws("|", "l_returnflag", "l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", flags.alias("flags"), (F.col("l_linenumber") % 2).cast("int").alias("stratum")
    )
    return stratified_sample(rows, ["stratum"], ["flags", "l_partkey"], 20, SEED)


@PLANS.add(
    f"""
    SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents
    WHERE substring({hash_sql("doc_id")}, 1, 8) < '{hash_threshold(15)}'
    """
)
def hash_sample_text(spark, sf_dir):
    sample = hash_sample(table(spark, sf_dir, "documents"), ["doc_id"], 15, SEED)
    return sample.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


_YEAR_RATES = {1995: 50, 1998: 10, 2001: 100}


@PLANS.add(
    f"WITH {_RANKED} SELECT {_COLUMNS} FROM placed WHERE CASE "
    + " ".join(
        f"WHEN stratum = {y} THEN substring({hash_sql('o_orderkey')}, 1, 8) < '{hash_threshold(p)}'"
        for y, p in _YEAR_RATES.items()
    )
    + " ELSE FALSE END"
)
def hash_sample_by_stratum(spark, sf_dir):
    return hash_sample_by(_orders(spark, sf_dir), "stratum", _YEAR_RATES, ["o_orderkey"], SEED)


@PLANS.add(
    "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS stratum, TRUE AS near_rate, TRUE AS from_stratum FROM orders"
)
def sample_by_random(spark, sf_dir):
    """Spark's random stratified draw: its rows change with the partitioning, its size hardly."""
    orders = _orders(spark, sf_dir)
    sizes = orders.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    fractions = {r["stratum"]: 0.15 for r in sizes.select("stratum").collect()}  # one row per year
    drawn = random_sample_by(orders, "stratum", fractions, SEED)
    counts = drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("drawn"))
    kept = F.coalesce("drawn", F.lit(0))
    # Six standard deviations of the number drawn.
    away = F.abs(kept - F.col("n") * 0.15) <= 6 * F.sqrt(F.col("n") * 0.15 * 0.85)
    inside = (kept >= 0) & (kept <= F.col("n"))
    return sizes.join(counts, "stratum", "left").select(
        "stratum", away.alias("near_rate"), inside.alias("from_stratum")
    )
