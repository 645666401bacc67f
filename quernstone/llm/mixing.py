"""Mix sources to target weights: every source's taken words are fitted to a budget.

Documents are counted by exact length. Whole rounds over a source come first; the rest of its budget
but a few documents' words is spread evenly over the lengths, and what then still lacks is filled by
bounded-knapsack dynamic programming over the lengths left, at every size of a source alike. Which documents of a length are taken follows a seeded hash, so
reruns agree. Only length counts meet in one task, a table that grows at most with the square root
of the words; documents of one length are ranked in slices by hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.support.cut import Size, cut, cut_measured
from quernstone.support.names import unused
from quernstone.support.ranking import rank_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17

# Words of a source's budget that the dynamic programme fills at most; a bit for each is held.
DP_WORDS = 1 << 16
# Documents of mean length that the spread leaves to it at first, and how much more where these do not fit.
REST_DOCUMENTS, REST_GROWTH = 4, 4

# Documents of one length in a slice, on average, and the most slices of a length.
SLICE_ROWS = 512
MOST_SLICES = 1 << 16

# Fixed value: the golden ratio's fraction, whose multiples are spread evenly.
GOLDEN = 0.6180339887498949

BROADCAST_ROWS = 500_000

_WHITE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t-\r]+"))).cast("long")


def _lookup(large: DataFrame, small: DataFrame, size: Size, on: Column) -> DataFrame:
    """Left join with at most one match; a broadcast only within a measured bound."""
    return large.join(F.broadcast(small) if size.rows <= BROADCAST_ROWS else small, on, "left")


def fill(lengths: list[int], counts: list[int], budget: int) -> tuple[dict[int, int], int]:
    """Bounded knapsack: documents to take of each length, and the words they hold.

    The sum is the largest one not above ``budget`` (at most DP_WORDS) that the counts can make.
    """
    reach, layers = 1, []
    keep = (1 << (budget + 1)) - 1
    # Far apart one after the other, so that no end of the lengths is used up first.
    spread = sorted(enumerate(sorted(zip(lengths, counts, strict=True))), key=lambda x: x[0] * GOLDEN % 1)
    for _, (length, count) in spread:
        if reach >> budget & 1:
            break
        if length > budget:
            continue
        left, step = min(count, budget // length), 1
        while left > 0:
            several = min(step, left)
            after = (reach | reach << several * length) & keep
            if after != reach:
                layers.append((reach, length, several))
            reach, left, step = after, left - several, step * 2
    total = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for before, length, several in reversed(layers):
        if not before >> at & 1:
            at -= several * length
            taken[length] = taken.get(length, 0) + several
    return taken, total


def _evenly(lengths: list[int], counts: list[int], words: int, most: int) -> list[int]:
    """Documents of each length, the same share of all, that hold ``words`` or so and never more than ``most``."""
    everything, more, seen = sum(a * b for a, b in zip(lengths, counts, strict=True)), [], 0
    for count in counts:
        more.append((seen + count) * words // everything - seen * words // everything)
        seen += count
    excess = sum(a * b for a, b in zip(lengths, more, strict=True)) - most
    while excess > 0:
        # The shortest document that makes up for it, else the longest.
        held = [i for i, m in enumerate(more) if m]
        i = next((i for i in held if lengths[i] >= excess), held[-1])
        fewer = max(1, min(more[i], excess // lengths[i]))
        more[i] -= fewer
        excess -= fewer * lengths[i]
    return more


def fit_lengths(lengths: list[int], counts: list[int], goal: int) -> tuple[int, list[int]]:
    """Rounds over all documents, and how many of each length are taken once more.

    ``lengths`` ascend and are positive. All of the rest of the goal but a few documents' words is spread evenly
    over the lengths; the dynamic programme fills these from the documents left. Where they have no
    choice that fits exactly, it gets more of the rest, up to all of it or half of DP_WORDS.
    """
    everything, documents = sum(a * b for a, b in zip(lengths, counts, strict=True)), sum(counts)
    rounds, budget = divmod(goal, everything) if everything else (0, 0)
    most = min(budget, DP_WORDS // 2)
    rest = min(most, REST_DOCUMENTS * everything // max(documents, 1))
    while True:
        more = _evenly(lengths, counts, budget - rest, budget) if budget > rest else [0] * len(lengths)
        left = [b - m for b, m in zip(counts, more, strict=True)]
        lack = budget - sum(a * b for a, b in zip(lengths, more, strict=True))
        for i in reversed(range(len(lengths))):
            # Only documents longer than DP_WORDS can leave so much.
            if lack >= DP_WORDS and lengths[i] <= lack:
                extra = min(left[i], (lack - DP_WORDS) // lengths[i] + 1)
                more[i], left[i], lack = more[i] + extra, left[i] - extra, lack - extra * lengths[i]
        taken, words = fill(lengths, left, min(lack, DP_WORDS))
        if words == lack or rest >= most:
            return rounds, [m + taken.get(a, 0) for a, m in zip(lengths, more, strict=True)]
        rest = min(most, max(1, rest) * REST_GROWTH)


def _plan_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    goal = int(group["target"].iloc[0] + 0.5)
    rounds, more = fit_lengths(group["size"].tolist(), group["n"].tolist(), goal)
    return pd.DataFrame(
        {"source_no": group["source_no"], "size": group["size"], "n": group["n"], "rounds": rounds, "more": more}
    )


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, Size]:
    """(source, source_no, source_size, target): shares by weight, none above ``most`` times its words."""
    sources, size = cut_measured(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = rank_rows(sources, [F.col("source").isNull(), F.col("source")], "source_no", size)
    which = F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1)
    ranked = cut(ranked.withColumn("weight", which.cast("double")), "sources-ranked")
    limit = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (total[0] or 0), 0.0
    if total[1]:
        level = budget / total[1]
        while True:
            # Words per unit of weight once the sources that are full keep their limit.
            full = limit <= F.col("weight") * F.lit(level)
            held, free = ranked.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
            higher = (budget - (held or 0.0)) / free if free else level
            if higher <= level:
                break
            level = higher
    target = F.least(limit, F.col("weight") * F.lit(level)).alias("target")
    return ranked.select("source", "source_no", "source_size", target), size


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies): how often each row is taken.

    Sources in order of their code points, null last, weigh ``weights`` in turn and share ``share`` of
    all words; a target above ``most`` times its source's words is cut there and the excess shared
    among the others. A null or wordless text has size 0 and 0 copies. Rows that repeat an id are
    documents of their own; ties of the seeded hash go by id, then by a hash of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = cut(
        docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col("source").cast("string"), word_count(text).alias("size")),
        "sizes",
    )
    targets, n_sources = _targets(sizes, weights, share, most)
    targets = targets.withColumnRenamed("source", "_source")
    placed = _lookup(sizes, targets, n_sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    counts = placed.filter("size > 0").groupBy("source_no", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first("target").alias("target")
    )
    plan, n_plan = cut_measured(
        counts.groupBy("source_no").applyInPandas(
            _plan_source, "source_no int, size long, n long, rounds int, more long"
        ),
        "lengths",
    )
    plan = plan.withColumnsRenamed({"source_no": "_no", "size": "_size"})
    of_length = (F.col("source_no") == F.col("_no")) & (F.col("size") == F.col("_size"))
    order = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    slices = F.least(F.lit(MOST_SLICES), F.ceil(F.col("n") / SLICE_ROWS)).cast("long")
    spread = _lookup(placed, plan, n_plan, of_length).drop("_no", "_size").withColumn("_order", F.shiftrightunsigned(order, 1))
    spread = spread.withColumn(
        "_slice", F.shiftrightunsigned(F.shiftrightunsigned("_order", 32) * slices, 31)
    )

    # The slice of a length at which its count is reached, and how many of that slice are taken.
    per_slice = spread.filter("more > 0").groupBy("source_no", "size", "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.first("more").alias("_more")
    )
    so_far = F.sum("_rows").over(Window.partitionBy("source_no", "size").orderBy("_slice"))
    cuts, n_cuts = cut_measured(
        per_slice.withColumn("_upto", so_far)
        .filter("_upto >= _more and _upto - _rows < _more")
        .select(
            F.col("source_no").alias("_no"),
            F.col("size").alias("_size"),
            F.col("_slice").alias("_cut"),
            (F.col("_more") - F.col("_upto") + F.col("_rows")).alias("_need"),
        ),
        "cuts",
    )
    in_slice = Window.partitionBy("source_no", "size", "_slice").orderBy("_order", "doc_id", "text_key")
    wordy = _lookup(spread.filter("size > 0"), cuts, n_cuts, of_length)
    ranked = wordy.withColumn("_rank", F.row_number().over(in_slice))
    again = (F.col("_slice") < F.col("_cut")) | ((F.col("_slice") == F.col("_cut")) & (F.col("_rank") <= F.col("_need")))
    copies = F.col("rounds") + F.coalesce(again, F.lit(False)).cast("int")
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    wordless = placed.filter("size = 0").select(*columns, F.lit(0).alias("copies"))
    return ranked.select(*columns, copies.alias("copies")).unionByName(wordless)


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others), each as often as the mix takes it.

    Null and wordless texts are taken not at all, an empty table gives none, ties go as in ``mix``. Rows that share
    id, text and source divide their copies. All columns stay, whatever their names.
    """
    names = unused(docs.columns, "_id", "_key", "_source", "_copies", "_rows", "_time", "_each")
    id_name, key_name, source_name, copies, rows_name, time, each_name = names
    taken = cut(
        mix(docs, **options)
        .groupBy(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), F.col("source").alias(source_name))
        .agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows_name))
        .filter(F.col(copies) > 0),
        "copies",
    )
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (key == F.col(key_name))
    same &= F.col("source").eqNullSafe(F.col(source_name))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        several = rows.withColumn(time, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        return several.select(docs.columns)

    single = repeated(docs.join(taken.filter(F.col(rows_name) == 1), same), F.col(copies))
    shared = taken.filter(F.col(rows_name) > 1)
    if shared.isEmpty():
        return single
    place = F.row_number().over(Window.partitionBy(id_name, key_name, source_name).orderBy(key_name))
    whole, more = F.floor(F.col(copies) / F.col(rows_name)), F.col(copies) % F.col(rows_name)
    divided = docs.join(shared, same).withColumn(each_name, whole + (place <= more).cast("long"))
    return single.unionByName(repeated(divided, F.col(each_name)))
