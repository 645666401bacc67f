"""quernstone: feature preprocessing on Spark, for tables too large for one machine."""

from quernstone.operators.binning import (
    CustomBinner,
    QuantileDiscretizer,
    QuantileDiscretizerModel,
    actual_bucket_count,
    bucket_distribution,
    distinct_buckets,
)
from quernstone.operators.features import FeatureAssembler, cached, project, row_count
from quernstone.operators.footers import footer_statistics
from quernstone.operators.logbuckets import log_bucket_quantiles, log_buckets, merged_buckets
from quernstone.operators.quantiles import (
    Maximum,
    Minimum,
    QuantileSketch,
    aggregate,
    approx_quantiles,
    bin_edges,
    exact_quantiles,
    mean_absolute_error,
    quantile_error,
    quantile_table,
    quantiles_by,
    rank_error,
    sketch_quantiles,
)
from quernstone.operators.rates import (
    fit_by_rate,
    merged_moments,
    moments,
    moments_by_rate,
    term_statistics_by_rate,
)
from quernstone.operators.sampling import (
    hash_sample,
    hash_sample_by,
    nested_samples,
    random_sample_by,
    stratified_sample,
)
from quernstone.operators.scaling import (
    MinMaxScaler,
    MinMaxScalerModel,
    StandardScaler,
    StandardScalerModel,
    VectorStandardScaler,
    VectorStandardScalerModel,
    min_max_statistics,
    standard_statistics,
)
from quernstone.operators.text import (
    CountVectorizer,
    CountVectorizerModel,
    Tokenizer,
    document_terms,
    frequent_terms,
    term_statistics,
    top_terms,
)
from quernstone.operators.trace import (
    capacity_share,
    executor_spans,
    parse_task_ends,
    parse_trace,
    read_task_ends,
    read_trace,
    task_overhead,
    task_overhead_by_job,
    utilisation,
)

__all__ = [
    "CountVectorizer",
    "CountVectorizerModel",
    "CustomBinner",
    "FeatureAssembler",
    "Maximum",
    "MinMaxScaler",
    "MinMaxScalerModel",
    "Minimum",
    "QuantileDiscretizer",
    "QuantileDiscretizerModel",
    "QuantileSketch",
    "StandardScaler",
    "StandardScalerModel",
    "Tokenizer",
    "VectorStandardScaler",
    "VectorStandardScalerModel",
    "actual_bucket_count",
    "aggregate",
    "approx_quantiles",
    "bin_edges",
    "bucket_distribution",
    "cached",
    "capacity_share",
    "distinct_buckets",
    "document_terms",
    "exact_quantiles",
    "executor_spans",
    "fit_by_rate",
    "footer_statistics",
    "frequent_terms",
    "hash_sample",
    "hash_sample_by",
    "log_bucket_quantiles",
    "log_buckets",
    "mean_absolute_error",
    "merged_buckets",
    "merged_moments",
    "min_max_statistics",
    "moments",
    "moments_by_rate",
    "nested_samples",
    "parse_task_ends",
    "parse_trace",
    "project",
    "quantile_error",
    "quantile_table",
    "quantiles_by",
    "random_sample_by",
    "rank_error",
    "read_task_ends",
    "read_trace",
    "row_count",
    "sketch_quantiles",
    "standard_statistics",
    "stratified_sample",
    "task_overhead",
    "task_overhead_by_job",
    "term_statistics",
    "term_statistics_by_rate",
    "top_terms",
    "utilisation",
]
