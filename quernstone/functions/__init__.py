"""Column expressions. Each one is built from Spark's own functions, without Python UDFs."""

from quernstone.functions.keys import hash_key, hash_threshold
from quernstone.functions.numeric import (
    min_max_scaled,
    missing_sql,
    present_sql,
    standardised,
    unless_missing,
)
from quernstone.functions.probabilities import even_probabilities, rank_of, sketch_size
from quernstone.functions.steps import bin_left_closed, bin_right_closed, interval_tag
from quernstone.functions.text import (
    run_lengths,
    run_starts,
    split_body,
    token_body,
)

__all__ = [
    "bin_left_closed",
    "bin_right_closed",
    "even_probabilities",
    "hash_key",
    "hash_threshold",
    "interval_tag",
    "min_max_scaled",
    "missing_sql",
    "present_sql",
    "rank_of",
    "run_lengths",
    "run_starts",
    "sketch_size",
    "split_body",
    "standardised",
    "token_body",
    "unless_missing",
]
