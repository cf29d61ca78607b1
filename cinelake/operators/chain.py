"""Chains of frame filters: functions from DataFrame to DataFrame, composed into one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]


@dataclass
class FilterChain:
    """Filters in order.  Catalyst fuses those that are column functions into one projection."""

    filters: list[tuple[str, Filter]] = field(default_factory=list)

    def add(self, name: str, f: Filter) -> FilterChain:
        return FilterChain([*self.filters, (name, f)])

    def apply(self, frames: DataFrame) -> DataFrame:
        for _, f in self.filters:
            frames = f(frames)
        return frames

    def flush(self, frames: DataFrame) -> list[DataFrame]:
        """What each filter still holds after the last frame (``name`` -> ``flushes``); it passes no later filter."""
        return [f.flush(frames) for _, f in self.filters if hasattr(f, "flush")]

    def fan_out(self, frames: DataFrame) -> DataFrame:
        """All outputs of all filters: each maps every frame to none or many, as ``output`` counts."""
        for _, f in self.filters:
            frames = f(frames)
        return frames

    def one_each(self, frames: DataFrame, key: list[str]) -> DataFrame:
        """The first output of the chain for each frame of ``key`` (by ``output``); a frame without one is an error."""
        made = self.fan_out(frames)
        first = made.groupBy(*key).agg(F.min_by(F.struct(*made.columns), "output").alias("_f"))
        rows = frames.select(*key).distinct().join(first, key, "left")
        checked = F.when(F.col("_f").isNull(), F.raise_error(F.lit("a filter gave no frame")).cast(made.schema.simpleString())).otherwise(F.col("_f"))
        return rows.select(checked.alias("_f")).select("_f.*")

    def names(self) -> list[str]:
        return [name for name, _ in self.filters]
