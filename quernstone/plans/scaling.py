"""Standardising and min-max scaling of lineitem."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quernstone.operators.features import FeatureAssembler
from quernstone.operators.binning import CustomBinner
from quernstone.operators.rates import fit_by_rate, merged_moments, moments, moments_by_rate
from quernstone.operators.scaling import (
    MinMaxScaler,
    StandardScaler,
    VectorStandardScaler,
    min_max_statistics,
    standard_statistics,
)
from quernstone.plans.registry import Plans, table
from quernstone.plans.tables import FEATURES
from quernstone.support.cut import scratch_path

PLANS = Plans()


def _rounded(df, names, *kept):
    return df.select(*kept, *[F.round(n, 6).alias(n) for n in names])


def _scaled_sql(spread: str = "stddev_samp", pattern: str = "scaled_{}") -> str:
    fits = ", ".join(f"avg({c}) AS m_{c}, {spread}({c}) AS s_{c}" for c in FEATURES)
    outs = ", ".join(
        f"round(CASE WHEN coalesce(s_{c}, 0) = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END, 6) AS "
        + pattern.format(c)
        for c in FEATURES
    )
    return f"SELECT l_orderkey, {outs} FROM lineitem, (SELECT {fits} FROM lineitem)"


@PLANS.add(
    "SELECT "
    + ", ".join(
        f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in FEATURES
    )
    + " FROM lineitem"
)
def scaler_fit_stats(spark, sf_dir):
    found = standard_statistics(table(spark, sf_dir, "lineitem"), FEATURES)
    return _rounded(found, found.columns)


@PLANS.add(_scaled_sql())
def scaler_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES)
    scaled = StandardScaler(FEATURES).fit_transform(rows)
    return _rounded(scaled, [f"scaled_{c}" for c in FEATURES], "l_orderkey")


@PLANS.add(_scaled_sql("stddev_pop", "z_{}"))
def scaler_output_columns(spark, sf_dir):
    """Population deviation, into named output columns."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES)
    names = [f"z_{c}" for c in FEATURES]
    scaled = StandardScaler(FEATURES, output_columns=names, ddof=0).fit_transform(rows)
    return _rounded(scaled, names, "l_orderkey")


@PLANS.add(_scaled_sql())
def scaler_feature_array(spark, sf_dir):
    """Assemble, then scale the assembled array."""
    return _scaled_features(spark, sf_dir, as_vector=False)


@PLANS.add(_scaled_sql())
def scaler_feature_vector(spark, sf_dir):
    """Assemble an ML vector, then scale the vector."""
    return _scaled_features(spark, sf_dir, as_vector=True)


def _scaled_features(spark, sf_dir, as_vector):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES)
    steps = Pipeline(
        stages=[FeatureAssembler(FEATURES, as_vector=as_vector), VectorStandardScaler()]
    )
    scaled = steps.fit(rows).transform(rows)
    if as_vector:
        # The stored values of a dense vector.
        values = F.unwrap_udt("scaled_features")["values"]
        scaled = scaled.withColumn("scaled_features", values)
    return scaled.select(
        "l_orderkey",
        *[
            F.round(F.col("scaled_features")[i], 6).alias(f"scaled_{c}")
            for i, c in enumerate(FEATURES)
        ],
    )


_GAPS = """
    SELECT l_orderkey, nullif(l_discount, 0) AS discount,
           CASE WHEN l_tax <> 0.05 THEN l_tax END AS tax
    FROM lineitem
"""
_SCALED_GAPS = """
    SELECT l_orderkey,
           round((discount - m1) / s1, 6) AS scaled_discount,
           round((tax - m2) / s2, 6) AS scaled_tax
    FROM gaps, (SELECT avg(discount) AS m1, stddev_samp(discount) AS s1,
                       avg(tax) AS m2, stddev_samp(tax) AS s2 FROM gaps)
"""


def _gaps(spark, sf_dir, missing):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "nullif(l_discount, 0D) AS discount",
        f"CASE WHEN l_tax <> 0.05D THEN l_tax ELSE {missing} END AS tax",
    )


@PLANS.add(f"WITH gaps AS ({_GAPS}) {_SCALED_GAPS}")
def scaler_keep_missing(spark, sf_dir):
    """Nulls left out of the statistics, column by column, and passed through."""
    scaler = StandardScaler(["discount", "tax"], invalid="keep")
    scaled = scaler.fit_transform(_gaps(spark, sf_dir, "NULL"))
    return _rounded(scaled, ["scaled_discount", "scaled_tax"], "l_orderkey")


@PLANS.add(
    f"WITH gaps AS (SELECT * FROM ({_GAPS}) WHERE discount IS NOT NULL AND tax IS NOT NULL) "
    + _SCALED_GAPS
)
def scaler_skip_missing(spark, sf_dir):
    """Rows with a null or NaN in any scaled column dropped from fit and output."""
    scaler = StandardScaler(["discount", "tax"], invalid="skip")
    scaled = scaler.fit_transform(_gaps(spark, sf_dir, "double('NaN')"))
    return _rounded(scaled, ["scaled_discount", "scaled_tax"], "l_orderkey")


@PLANS.add("SELECT l_orderkey, 0.0::DOUBLE AS scaled_level FROM lineitem")
def scaler_constant_column(spark, sf_dir):
    """A column without spread scales to zero."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_quantity - l_quantity + 5D AS level"
    )
    return StandardScaler(["level"]).fit_transform(rows).select("l_orderkey", "scaled_level")


@PLANS.add(
    "SELECT "
    + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in FEATURES)
    + " FROM lineitem"
)
def min_max_fit_stats(spark, sf_dir):
    return min_max_statistics(table(spark, sf_dir, "lineitem"), FEATURES)


def _min_max_sql(low: float, high: float) -> str:
    fits = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in FEATURES)
    outs = ", ".join(
        f"round(({c} - a_{c}) / (b_{c} - a_{c}) * ({high} - ({low})) + ({low}), 6) AS scaled_{c}"
        for c in FEATURES
    )
    return f"SELECT l_orderkey, {outs} FROM lineitem, (SELECT {fits} FROM lineitem)"


@PLANS.add(_min_max_sql(0.0, 1.0))
def min_max_transform(spark, sf_dir):
    return _min_max(spark, sf_dir, MinMaxScaler(FEATURES))


@PLANS.add(_min_max_sql(-1.0, 1.0))
def min_max_symmetric(spark, sf_dir):
    return _min_max(spark, sf_dir, MinMaxScaler(FEATURES, low=-1.0, high=1.0))


def _min_max(spark, sf_dir, scaler):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES)
    scaled = scaler.fit_transform(rows)
    return _rounded(scaled, [f"scaled_{c}" for c in FEATURES], "l_orderkey")


# The sample rates in percent.
RATES = list(range(5, 96, 10))
_RATED = "(SELECT *, CAST(l_orderkey % 100 + 1 AS INTEGER) AS first_rate FROM lineitem)"


def _rated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES)
    return rows.withColumn("first_rate", (F.col("l_orderkey") % 100 + 1).cast("int"))


@PLANS.add(
    "SELECT rate, "
    + ", ".join(
        f"count({c}) AS n_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}, "
        f"min({c}) AS min_{c}, max({c}) AS max_{c}"
        for c in FEATURES
    )
    + f" FROM {_RATED}, (SELECT unnest({RATES}) AS rate) WHERE first_rate <= rate GROUP BY rate"
)
def scaler_fit_by_rate(spark, sf_dir):
    """The fits of ten nested samples from one scan."""
    found = moments_by_rate(moments(_rated(spark, sf_dir), FEATURES), FEATURES, RATES)
    rounded = [c for c in found.columns if c.startswith(("mean_", "std_"))]
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@PLANS.add(
    "SELECT rate, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in FEATURES)
    + f" FROM {_RATED}, (SELECT unnest({RATES}) AS rate) WHERE first_rate <= rate GROUP BY rate"
)
def scaler_fit_by_rate_later_rows(spark, sf_dir):
    """States of the rows so far and of rows that come later, put together."""
    rows = _rated(spark, sf_dir)
    now = F.col("l_orderkey") % 7 <= 3
    parts = [moments(rows.filter(some), FEATURES) for some in (now, ~now)]
    states = merged_moments(parts[0].unionByName(parts[1]), FEATURES)
    found = moments_by_rate(states, FEATURES, RATES)
    return found.select("rate", *[F.round(f"{n}_{c}", 6).alias(f"{n}_{c}") for c in FEATURES for n in ("mean", "std")])


@PLANS.add(
    f"""
    WITH fits AS (
        SELECT rate, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s
        FROM {_RATED}, (SELECT unnest([5, 45]) AS rate) WHERE first_rate <= rate GROUP BY rate
    )
    SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT m FROM fits WHERE rate = 5))
               / (SELECT s FROM fits WHERE rate = 5), 6) AS at_5,
           round((l_quantity - (SELECT m FROM fits WHERE rate = 45)) / (SELECT s FROM fits WHERE rate = 45), 6) AS at_45
    FROM lineitem
    """
)
def scaler_transform_by_rate(spark, sf_dir):
    """Models of two samples, from one scan, applied to the whole table."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rated = rows.withColumn("first_rate", (F.col("l_orderkey") % 100 + 1).cast("int"))
    models = fit_by_rate(StandardScaler(["l_quantity"]), rated, [5, 45])
    five = models[5].transform(rows).withColumnRenamed("scaled_l_quantity", "at_5")
    both = models[45].transform(five).withColumnRenamed("scaled_l_quantity", "at_45")
    return _rounded(both, ["at_5", "at_45"], "l_orderkey", "l_linenumber")


@PLANS.add(
    """
    WITH fits AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem),
    scaled AS (SELECT l_orderkey, l_linenumber, (l_quantity - m) / s AS z FROM lineitem, fits)
    SELECT l_orderkey, l_linenumber, round(z, 6) AS scaled_l_quantity,
           CAST(CASE WHEN z <= -1 THEN 0 WHEN z <= 0 THEN 1 WHEN z <= 1 THEN 2 ELSE 3 END AS INTEGER) AS level
    FROM scaled
    """
)
def stored_scaler_and_bins(spark, sf_dir):
    """A pipeline of scaler and binner written, loaded and applied."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    bins = CustomBinner({"scaled_l_quantity": [-9, -1, 0, 1, 9]}, ["level"])
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[StandardScaler(["l_quantity"]), bins]).fit(rows).write().save(path)
    found = PipelineModel.load(path).transform(rows)
    return _rounded(found, ["scaled_l_quantity"], "l_orderkey", "l_linenumber", "level")
