"""Exact and approximate quantiles, sketches, and the error of one against the other.

Quantiles are discrete: the value at rank ``ceil(p * n)`` of the non-missing values. Null and NaN
are left out everywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegralType

from quernstone.functions.numeric import present_sql
from quernstone.functions.probabilities import (
    MOST_SKETCH_SIZE,
    check_sketch_size,
    even_probabilities,
    rank_of,
    sketch_error,
    sketch_size,
)
from quernstone.functions.steps import interval_tag
from quernstone.support.cut import cut, cut_measured, discard

# Sketch size of the first guess per ten probabilities, and the distinct values that one window
# task may order.
GUESS_SIZE = 4096
WINDOW_ROWS = 1_000_000

# Distinct values inside brackets that are looked through on the driver rather than in another job.
LOCAL_ENTRIES = 20_000

# Pivots per narrowing round of a bracket with more values than that.
PIVOTS = 64

# Groups that merge sketches before the final merge.
MERGE_GROUPS = 64


def _number(name: str) -> Column:
    return F.expr(present_sql(name))


# --- exact -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Target:
    """One wanted value: the ``rank``-th of the values that column ``place`` keeps under ``tag``."""

    slot: int
    place: int
    tag: int
    rank: int


def _rank_margin(size: int) -> float:
    """Four times the rank error that a sketch of this size keeps with 99% confidence."""
    return 4 * sketch_error(size)


def _disjoint(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Merge overlapping closed intervals."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(pairs):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _tagged_values(df: DataFrame, columns: list[str], brackets: list[list[tuple]]) -> DataFrame:
    """``(place, tag, value)`` per non-missing value; ``value`` is null outside the brackets."""
    parts = []
    for i, c in enumerate(columns):
        tag = interval_tag(c, brackets[i])
        inside = F.when(tag % 2 == 1, F.col(c))
        parts.append(F.struct(F.lit(i).alias("place"), tag.alias("tag"), inside.alias("value")))
    spread_out = df.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    return spread_out.filter(F.col("tag").isNotNull())


def _narrow(values: DataFrame, rank: int, entries: int, window_rows: int) -> float:
    """The ``rank``-th value of a ``(value, cnt)`` table, cutting it down before ordering it.

    Pivots are doubles; exact numbers that share one are ordered at the end.
    """
    exact = values.schema["value"].dataType != DoubleType()
    while entries > window_rows:
        steps = [i / PIVOTS for i in range(1, PIVOTS)]
        pivots = sorted(set(values.approxQuantile("value", steps, 1 / (4 * PIVOTS))))
        tag = interval_tag("value", [(p, p) for p in pivots])
        tallied = (
            values.groupBy(tag.alias("tag"))
            .agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("entries"))
            .orderBy("tag")
            .collect()  # at most 2 * PIVOTS rows
        )
        for row in tallied:
            if rank <= row["rows"]:
                break
            rank -= row["rows"]
        place, at_pivot = divmod(row["tag"], 2)
        if at_pivot and exact:
            values = values.filter(F.col("value").cast("double") == pivots[place])
            break
        if at_pivot:
            return pivots[place]
        if place > 0:
            values = values.filter(F.col("value") > pivots[place - 1])
        if place < len(pivots):
            values = values.filter(F.col("value") < pivots[place])
        entries = row["entries"]
    running = F.sum("cnt").over(Window.orderBy("value"))
    reached = values.select("value", running.alias("upto")).filter(F.col("upto") >= rank)
    return reached.agg(F.min("value")).first()[0]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    guess_size: int = GUESS_SIZE,
    window_rows: int = WINDOW_ROWS,
) -> dict[str, list[float | None]]:
    """Exact discrete quantiles of several columns; None for a column without values.

    Integers and decimals are counted and ordered as such, and returned as such; all else as doubles.

    A sketch pass brackets every wanted rank. A counting pass then keeps the distinct values
    inside the brackets with their counts and only a total for each gap between them. Both passes
    serve all columns and probabilities and combine in every task, so a value that fills a third
    of the table travels as one count. A bracket still too large to order in one task is narrowed
    by exact counts around pivots; a rank outside its bracket is found the same way in its gap.
    """
    found: dict[str, list] = {}
    for kind, names in _by_type(df, list(columns)).items():
        found |= _exact_of_type(df, names, kind, probabilities, guess_size, window_rows)
    return {c: found[c] for c in columns}


def _by_type(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Columns that can be counted in one table: by their exact type, or as doubles."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        kind = df.select(c).schema[0].dataType
        if isinstance(kind, IntegralType):
            name = "long"
        else:
            name = kind.simpleString() if isinstance(kind, DecimalType) else "double"
        groups.setdefault(name, []).append(c)
    return groups


def _exact_of_type(
    df: DataFrame,
    names: list[str],
    kind: str,
    probabilities: Sequence[float],
    guess_size: int,
    window_rows: int,
) -> dict[str, list]:
    wanted = [float(p) for p in probabilities]
    size = min(MOST_SKETCH_SIZE, guess_size * max(1, -(-len(wanted) // 10)))
    margin = _rank_margin(size)
    bounds = [q for p in wanted for q in (max(0.0, p - margin), min(1.0, p + margin))]
    typed = [_number(c) if kind == "double" else F.col(c).cast(kind) for c in names]
    numbers = df.select(*[value.alias(f"c{i}") for i, value in enumerate(typed)])
    places = [f"c{i}" for i in range(len(names))]
    guesses = sketch_quantiles(numbers, places, bounds, size)
    brackets = []
    for place in places:
        pairs = zip(guesses[place][::2], guesses[place][1::2], strict=True)
        brackets.append(_disjoint([(low, high) for low, high in pairs if low is not None]))

    counted = _tagged_values(numbers, places, brackets).groupBy("place", "tag", "value")
    table, size = cut_measured(counted.agg(F.count(F.lit(1)).alias("cnt")), "quantile-counts")
    summed = table.groupBy("place", "tag").agg(
        F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("entries")
    )
    held: list | None = None
    if size.rows <= min(LOCAL_ENTRIES, window_rows):
        held = table.collect()  # few enough to be looked through here
        tallies = _tally(held)
    else:
        tallies = summed.collect()  # one row per bracket and gap
    totals: dict[int, dict[int, tuple[int, int]]] = {}
    for place, tag, rows, entries in tallies:
        totals.setdefault(place, {})[tag] = (rows, entries)

    found: dict[int, float | None] = {}
    ordered_here: list[_Target] = []
    for place in range(len(names)):
        sizes = totals.get(place, {})
        n = sum(rows for rows, _ in sizes.values())
        for j, p in enumerate(wanted):
            slot = place * len(wanted) + j
            if n == 0:
                found[slot] = None
                continue
            rank = rank_of(p, n)
            for tag in sorted(sizes):
                if rank <= sizes[tag][0]:
                    break
                rank -= sizes[tag][0]
            target = _Target(slot, place, tag, rank)
            if tag % 2 == 1 and sizes[tag][1] <= window_rows:
                ordered_here.append(target)
            else:
                found[slot] = _find_apart(
                    numbers, places[place], table, target, brackets[place], sizes, window_rows
                )
    found.update(_find_together(table, ordered_here) if held is None else _find_held(held, ordered_here))
    discard(table)
    return {
        c: [found[i * len(wanted) + j] for j in range(len(wanted))] for i, c in enumerate(names)
    }


def _tally(held: list) -> list[tuple]:
    """Rows and entries per bracket and gap of a collected table."""
    rows, entries = Counter(), Counter()
    for row in held:
        rows[row["place"], row["tag"]] += row["cnt"]
        entries[row["place"], row["tag"]] += 1
    return [(*key, n, entries[key]) for key, n in rows.items()]


def _find_held(held: list, targets: list[_Target]) -> dict[int, float]:
    """All targets, from a collected table."""
    inside: dict[tuple, list] = {}
    for row in held:
        inside.setdefault((row["place"], row["tag"]), []).append((row["value"], row["cnt"]))
    found = {}
    for t in targets:
        rank = t.rank
        for value, count in sorted(inside[t.place, t.tag]):
            rank -= count
            if rank <= 0:
                found[t.slot] = value
                break
    return found


def _find_together(table: DataFrame, targets: list[_Target]) -> dict[int, float]:
    """All targets whose brackets are small enough for one window task each, in one job."""
    if not targets:
        return {}
    rows = ", ".join(f"({t.slot}, {t.place}, {t.tag}, {t.rank}L)" for t in targets)
    asked = table.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(slot, place, tag, rank)")
    brackets = ", ".join(f"({p}, {t})" for p, t in sorted({(t.place, t.tag) for t in targets}))
    inside = Window.partitionBy("place", "tag").orderBy("value")
    running = table.filter(f"(place, tag) IN ({brackets})").select(
        "place", "tag", "value", "cnt", F.sum("cnt").over(inside).alias("upto")
    )
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("cnt") < F.col("rank"))
    found = running.join(F.broadcast(asked), ["place", "tag"]).filter(hit).select("slot", "value")
    return {r["slot"]: r["value"] for r in found.collect()}  # one row per target


def _find_apart(
    numbers: DataFrame,
    column: str,
    table: DataFrame,
    target: _Target,
    brackets: list[tuple[float, float]],
    sizes: dict[int, tuple[int, int]],
    window_rows: int,
) -> float:
    """A target in a large bracket, or in a gap because the sketch missed its rank."""
    bracket, inside = divmod(target.tag, 2)
    if inside:
        here = (F.col("place") == target.place) & (F.col("tag") == target.tag)
        values, entries = table.filter(here).select("value", "cnt"), sizes[target.tag][1]
    else:
        value = F.col(column)
        rows = numbers.filter(value.isNotNull())
        if bracket > 0:
            rows = rows.filter(value > brackets[bracket - 1][1])
        if bracket < len(brackets):
            rows = rows.filter(value < brackets[bracket][0])
        gap = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
        values = cut(gap, "quantile-gap")
        found = _narrow(values, target.rank, values.count(), window_rows)
        discard(values)
        return found
    return _narrow(values, target.rank, entries, window_rows)


# --- approximate -------------------------------------------------------------------------------


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], relative_error: float
) -> dict[str, list[float | None]]:
    """Quantiles whose rank is off by at most ``relative_error * n`` (Greenwald-Khanna summary).

    A summary without error would hold every value, so an error of 0 takes the exact path.
    """
    if relative_error == 0:
        return exact_quantiles(df, columns, probabilities)
    names = list(columns)
    numbers = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(names)])
    wanted = [float(p) for p in probabilities]
    found = numbers.approxQuantile([f"c{i}" for i in range(len(names))], wanted, relative_error)
    return {c: list(q) if q else [None] * len(wanted) for c, q in zip(names, found, strict=True)}


@dataclass(frozen=True)
class QuantileSketch:
    """A quantile aggregate of one column: a mergeable sketch of size ``precision``."""

    on: str
    quantiles: Sequence[float]
    precision: int = 100

    def __post_init__(self):
        check_sketch_size(self.precision)

    @property
    def name(self) -> str:
        return f"approx_quantile({self.on})"


@dataclass(frozen=True)
class Minimum:
    on: str

    @property
    def name(self) -> str:
        return f"min({self.on})"


@dataclass(frozen=True)
class Maximum:
    on: str

    @property
    def name(self) -> str:
        return f"max({self.on})"


def aggregate(df: DataFrame, *aggregates: QuantileSketch | Minimum | Maximum) -> DataFrame:
    """Any mix of whole-table aggregates in one pass, as one row with one column per aggregate.

    Task results are merged in groups first and then together, so that the last task receives a
    fixed number of sketches, however many tasks read the table.
    """
    first, second, final = [], [], []
    for i, a in enumerate(aggregates):
        value, name = _number(a.on), f"a{i}"
        if isinstance(a, QuantileSketch):
            size = F.lit(a.precision)
            first.append(F.kll_sketch_agg_double(value, size).alias(name))
            second.append(F.kll_merge_agg_double(name, size).alias(name))
            wanted = F.array(*[F.lit(float(q)) for q in a.quantiles])
            filled = F.kll_sketch_get_n_double(name) > 0
            final.append(
                F.when(filled, F.kll_sketch_get_quantile_double(name, wanted)).alias(a.name)
            )
        else:
            merge = F.min if isinstance(a, Minimum) else F.max
            first.append(merge(value).alias(name))
            second.append(merge(name).alias(name))
            final.append(F.col(name).alias(a.name))
    columns = list(dict.fromkeys(a.on for a in aggregates))
    grouped = df.select(*columns, (F.spark_partition_id() % MERGE_GROUPS).alias("_group"))
    return grouped.groupBy("_group").agg(*first).agg(*second).select(*final)


def sketch_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], precision: int
) -> dict[str, list[float | None]]:
    """Sketch quantiles of several columns in one pass."""
    sketches = [QuantileSketch(c, probabilities, precision) for c in columns]
    row = aggregate(df, *sketches).first()
    empty = [None] * len(probabilities)
    return {s.on: empty if row[s.name] is None else list(row[s.name]) for s in sketches}


# --- by-products -------------------------------------------------------------------------------


def quantiles_by(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    method: str = "exact",
    relative_error: float = 0.01,
) -> dict[str, list[float | None]]:
    """Quantiles by ``exact``, ``summary`` or ``sketch``, the last two within a rank error."""
    if method == "exact":
        found = exact_quantiles(df, columns, probabilities)
        return {c: [None if v is None else float(v) for v in vs] for c, vs in found.items()}
    if method == "summary":
        return approx_quantiles(df, columns, probabilities, relative_error)
    if method == "sketch":
        return sketch_quantiles(df, columns, probabilities, sketch_size(relative_error))
    raise ValueError("method must be 'exact', 'summary' or 'sketch'")


def quantile_table(
    spark: SparkSession, found: dict[str, list[float | None]], probabilities: Sequence[float]
) -> DataFrame:
    """``(column_name, prob, value)``: the quantiles found, one row each."""
    rows = [
        (c, float(p), None if v is None else float(v))
        for c, values in found.items()
        for p, v in zip(probabilities, values, strict=True)
    ]
    return spark.createDataFrame(rows, "column_name string, prob double, value double")


def bin_edges(
    df: DataFrame,
    column: str,
    num_buckets: int,
    method: str = "exact",
    relative_error: float = 0.01,
) -> list[float]:
    """``[min] + inner quantiles + [max]``, repeated values included; empty without values."""
    probabilities = even_probabilities(num_buckets)
    if method == "sketch":
        sketch = QuantileSketch(column, probabilities, sketch_size(relative_error))
        row = aggregate(df, sketch, Minimum(column), Maximum(column)).first()
        low, inner, high = row[f"min({column})"], row[sketch.name], row[f"max({column})"]
    else:
        # The least and the largest value are quantiles too, so no further pass is needed.
        wanted = [0.0, *probabilities, 1.0]
        low, *inner, high = quantiles_by(df, [column], wanted, method, relative_error)[column]
        if method == "summary" and low is not None:
            low, high = df.agg(F.min(_number(column)), F.max(_number(column))).first()
    return [] if low is None else [float(e) for e in (low, *inner, high)]


def quantile_error(
    spark: SparkSession,
    probabilities: Sequence[float],
    exact: Sequence[float],
    approx: Sequence[float],
) -> DataFrame:
    """``(prob, exact_value, approx_value, abs_error)`` per probability."""
    rows = list(zip(*(map(float, x) for x in (probabilities, exact, approx)), strict=True))
    table = spark.createDataFrame(rows, "prob double, exact_value double, approx_value double")
    return table.withColumn("abs_error", F.abs(F.col("approx_value") - F.col("exact_value")))


def mean_absolute_error(errors: DataFrame) -> DataFrame:
    """One row with the mean of ``abs_error``, as ``mae``."""
    return errors.agg(F.avg("abs_error").alias("mae"))


def rank_error(
    df: DataFrame, column: str, probabilities: Sequence[float], values: Sequence[float]
) -> DataFrame:
    """``(prob, value, rank_error)``: distance of each value's rank from ``p * n``, over ``n``.

    A repeated value covers a range of ranks; the distance is 0 when ``p * n`` lies inside it.
    """
    number = _number(column)
    counts = [F.count(number).alias("n")]
    for i, v in enumerate(values):
        counts.append(F.count_if(number < F.lit(v)).alias(f"below{i}"))
        counts.append(F.count_if(number <= F.lit(v)).alias(f"upto{i}"))
    parts = []
    for i, (p, v) in enumerate(zip(probabilities, values, strict=True)):
        goal = F.lit(float(p)) * F.col("n")
        away = F.greatest(F.col(f"below{i}") - goal, goal - F.col(f"upto{i}"), F.lit(0.0))
        parts.append(
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.lit(float(v)).alias("value"),
                (away / F.col("n")).alias("rank_error"),
            )
        )
    return df.agg(*counts).select(F.explode(F.array(*parts)).alias("r")).select("r.*")
