"""Which run dates a plan covers, and how daily rows relate to them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Runs:
    """Run dates ``first..last``. A run reports on the day before its run date."""

    first: date
    last: date

    def __post_init__(self):
        if self.first > self.last:
            raise ValueError(f"first run {self.first} is after last run {self.last}")

    @classmethod
    def single(cls, run_date: date) -> Runs:
        return cls(run_date, run_date)

    @classmethod
    def reporting(cls, first_report: date, last_report: date) -> Runs:
        day = timedelta(days=1)
        return cls(first_report + day, last_report + day)

    def back(self, days: int) -> date:
        """The earliest day any run reaches when each looks ``days`` back."""
        return self.first - timedelta(days=days)

    @property
    def last_report(self) -> date:
        return self.last - timedelta(days=1)

    def per_run(self, daily: DataFrame, back: int, until: int = 1) -> DataFrame:
        """Daily rows once for every run that sees them: ``dt`` in ``[run - back, run - until]``.

        Row-local, no join. Apply to folded daily results, never to raw facts: each row is
        repeated for up to ``back`` runs. With a single run it is a plain filter.
        """
        lo = F.greatest(F.date_add("dt", until), F.lit(self.first))
        hi = F.least(F.date_add("dt", back), F.lit(self.last))
        return daily.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("run_date"), "*")

    def on_report_day(self, compared: DataFrame) -> DataFrame:
        """Rows of each run's own report day. Use after all windows."""
        return compared.where(F.col("dt") == F.date_sub("run_date", 1))

    def stamp(self, compared: DataFrame) -> DataFrame:
        """Report days of one shared series, labelled with their run date."""
        day = F.col("dt").between(F.lit(self.first - timedelta(days=1)), F.lit(self.last_report))
        return compared.where(day).select(F.date_add("dt", 1).alias("run_date"), "*")
