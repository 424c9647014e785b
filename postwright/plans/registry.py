"""The register of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.plans.world import World

#: Decimals that results are compared at: sums come in any order. Adding zero makes a negative zero plain.
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    run: Callable[[World], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int = DIGITS

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(World(spark, sf_dir))
        return out.withColumns({c: (F.round(F.col(c).cast("double"), self.digits) + 0.0) for c in self.doubles}) if self.doubles else out

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {self.digits}) + 0.0::DOUBLE AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"


QUERIES: dict[str, Query] = {}


def query(rows: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a function of a World under its name; ``rows``: the inventory rows it shows, ``doubles``: columns to round.

    Sums of numbers with eight decimals are rounded to nine ``digits``, where no sum lies halfway.
    """

    def add(f: Callable[[World], DataFrame]):
        QUERIES[f.__name__] = Query(f.__name__, tuple(rows.split()), f, sql, tuple(doubles.split()), digits)
        return f

    return add
