"""Names of the roles columns play in a machine series (no positional logic)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class SeriesSchema:
    """Roles of the columns of a wide, time-bucketed machine table.

    keys        -- grouping columns; every operator works per key (e.g. site, machine)
    time_col    -- bucket time that orders the rows
    tie_cols    -- extra order columns making ``(time_col, *tie_cols)`` unique per key
    product_col -- product code column (filtered by ``product_filter``)
    meta_cols   -- non-feature columns that are neither keys nor time (e.g. time_bucket_utc)
    feature_cols -- numeric features; ``None`` means every numeric column not named above
    """

    keys: tuple[str, ...] = ()
    time_col: str = "time_bucket_local"
    tie_cols: tuple[str, ...] = ()
    product_col: str | None = "prod_code"
    meta_cols: tuple[str, ...] = ()
    feature_cols: tuple[str, ...] | None = field(default=None)

    @property
    def order(self) -> list[str]:
        return [self.time_col, *self.tie_cols]

    def non_features(self) -> list[str]:
        names = [*self.keys, self.time_col, *self.tie_cols, *self.meta_cols]
        if self.product_col:
            names.append(self.product_col)
        return names

    def features(self, df: DataFrame) -> list[str]:
        if self.feature_cols is not None:
            return [c for c in self.feature_cols if c in df.columns]
        skip = set(self.non_features())
        return [f.name for f in df.schema.fields
                if f.name not in skip and isinstance(f.dataType, NumericType)]

    def with_features(self, cols) -> "SeriesSchema":
        return replace(self, feature_cols=tuple(cols))
