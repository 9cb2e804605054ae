"""Threshold rules over wide counts: the first rule that fails, as one CASE chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COUNTERS, Config

#: Order of the upper bounds: as COUNTERS, but loops first. Fixed value.
MAX_ORDER = ["ForLoops", "WhileLoops", "CallFunc", *[c for c in COUNTERS if c not in ("ForLoops", "WhileLoops", "CallFunc")]]
EXEMPT = ("Program", "main")


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    bound: int
    upper: bool

    def fails(self) -> Column:
        return F.col(self.column) > self.bound if self.upper else F.col(self.column) < self.bound


def config_rules(config: Config) -> list[Rule]:
    """16 upper bounds, then 16 lower ones; bounds are inclusive."""
    upper = [Rule(f"max{c}", c, config[f"max{c}"], True) for c in MAX_ORDER]
    return upper + [Rule(f"min{c}", c, config[f"min{c}"], False) for c in COUNTERS]


def verdicts(counts: DataFrame, rules: list[Rule], key: str = "func", exempt: tuple = EXEMPT) -> DataFrame:
    """``counts`` with failed_rule (null if none) and removed; exempt keys never fail."""
    chain = F.when(F.col(key).isin(*exempt), F.lit(None).cast("string")) if exempt else None
    for r in rules:
        chain = F.when(r.fails(), r.name) if chain is None else chain.when(r.fails(), r.name)
    failed = chain if chain is not None else F.lit(None).cast("string")
    return counts.withColumn("failed_rule", failed).withColumn("removed", F.col("failed_rule").isNotNull())
