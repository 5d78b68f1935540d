"""All registered queries of the market-analytics operators: importing this module fills the registry."""

from barloom.plans import diagnostics_q, features_q, labels_q, long_q, quality_q, signals_q, statistics_q, windows_q  # noqa: F401
from barloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, d):
    return QUERIES["entry_ic_by_series"](spark, d)
