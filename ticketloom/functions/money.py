"""Rates and costs in whole rupees."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..policy import DEFAULT_POLICY, REPLACEMENT_LOGISTICS_INR, SupportPolicy
from .clean import _col, norm


def contact_rate(channel: Column | str, policy: SupportPolicy = DEFAULT_POLICY) -> Column:
    """Rate of the channel, or the blended rate when the channel has none."""
    key = norm(channel)
    rate = F.lit(policy.blended_rate).cast("long")
    for name, value in policy.contact_rates.items():
        rate = F.when(key == name, F.lit(value).cast("long")).otherwise(rate)
    return rate


def replacement_cost(unit_cost: Column | str) -> Column:
    return _col(unit_cost) + F.lit(REPLACEMENT_LOGISTICS_INR)
