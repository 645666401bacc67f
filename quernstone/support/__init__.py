"""Shared plan building blocks: lineage cuts, lookups, ranking, running sums."""
