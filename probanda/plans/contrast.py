"""Contrasts: which rows are treatment and which baseline, by arm names or by values of columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


@dataclass(frozen=True)
class Contrast:
    """Two arms by name, or two assignments of column values."""

    treatment: str = "treatment"
    baseline: str = "baseline"
    field: str = "arm_key"
    treatment_values: tuple[tuple[str, object], ...] = ()
    baseline_values: tuple[tuple[str, object], ...] = ()

    @classmethod
    def from_values(cls, treatment: dict[str, object], baseline: dict[str, object]) -> Contrast:
        for v in (*treatment.values(), *baseline.values()):
            if isinstance(v, float) and math.isnan(v):
                raise ValueError("NaN is no value of an arm")
        if set(treatment) != set(baseline):
            raise ValueError("both arms must set the same columns")
        return cls("treatment", "baseline", "contrast_arm", tuple(treatment.items()), tuple(baseline.items()))

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(k for k, _ in self.treatment_values) or (self.field,)

    def applied(self, cells: DataFrame) -> DataFrame:
        """The rows of either arm, with ``field`` naming the arm."""
        if not self.treatment_values:
            return cells.where(col(self.field).isin(self.treatment, self.baseline))

        def same(name: str, value: object) -> Column:
            numeric = isinstance(value, (bool, int, float))
            return (col(name).cast("double") == F.lit(float(value))) if numeric else col(name) == F.lit(value)

        match = lambda values: reduce(lambda a, b: a & b, [same(k, v) for k, v in values])
        arm = F.when(match(self.baseline_values), "baseline").when(match(self.treatment_values), "treatment")
        return cells.withColumn(self.field, arm).where(col(self.field).isNotNull())
