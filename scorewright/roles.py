"""Which column of a table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    target: str
    weight: str | None = None
    amount: str | None = None
    time: str | None = None
    sample_type: str | None = None
    keys: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default_factory=tuple)

    def check(self, df: DataFrame) -> None:
        named = [self.target, self.weight, self.amount, self.time, self.sample_type, *self.keys]
        missing = [c for c in named if c and c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")

    def non_features(self) -> list[str]:
        named = [self.target, self.weight, self.amount, self.time, self.sample_type, *self.keys, *self.exclude]
        return [c for c in dict.fromkeys(named) if c]
