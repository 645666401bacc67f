"""Named queries over the test tables, one or more per operator, each with a SQL twin."""

from quernstone.plans import binning, quantiles, sampling, scaling, tables, text, trace
from quernstone.plans.registry import Plan, Plans

__all__ = ["Plan", "Plans", "all_plans"]


def all_plans() -> Plans:
    """Every registered plan by name."""
    merged = Plans()
    for module in (tables, scaling, text, quantiles, binning, sampling, trace):
        for name, plan in module.PLANS.items():
            if name in merged:
                raise ValueError(f"plan {name} is registered twice")
            merged[name] = plan
    return merged
