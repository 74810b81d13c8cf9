"""Array projections: P1 nan_to_num, P2 flatten_frames, P6, P8, P9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(x: Column) -> Column:
    """NaN, +Inf, -Inf and NULL become 0 (scalar form of P1)."""
    return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0))
            .otherwise(x.cast("double")))


def nan_to_num(arr: Column) -> Column:
    """Element-wise NaN/Inf -> 0 over an array column."""
    return F.transform(arr, finite_or_zero)


def flatten_frames(frames: Column, is_global: Column, max_rows: int = 3) -> Column:
    """1-D stays as is; 2-D is zero-padded / truncated to `max_rows` rows
    and flattened row-major."""
    width = F.size(F.element_at(frames, 1))
    zero_row = F.array_repeat(F.lit(0.0), width)
    padded = F.concat(F.transform(frames, lambda r: F.transform(r, lambda x: x.cast("double"))),
                      F.array_repeat(zero_row, max_rows))
    two_d = F.flatten(F.slice(padded, 1, max_rows))
    one_d = F.transform(F.element_at(frames, 1), lambda x: x.cast("double"))
    return F.when(is_global, one_d).otherwise(two_d)


def has_missing(arr: Column) -> Column:
    """P6 predicate: any NULL or NaN in the vector."""
    return F.exists(arr, lambda x: x.isNull() | F.isnan(x))


def has_markers(features: Column, markers: Column, require_all: Column) -> Column:
    """ALL / ANY of `markers` in the pipe-joined feature list."""
    parts = F.split(features, "[|]")
    return F.when(require_all, F.forall(markers, lambda m: F.array_contains(parts, m))) \
        .otherwise(F.arrays_overlap(parts, markers))


def features_string(sets: Column) -> Column:
    """Pipe-join a feature-set list."""
    return F.array_join(sets, "|")


def round6(x: Column) -> Column:
    """Report rounding used by every checked output: through DECIMAL(38,9)
    first, so last-bit noise from summation order cannot flip a decimal tie,
    then half-up to 6 places; NaN/Inf pass through; -0.0 folds to 0.0."""
    x = x.cast("double")
    dec = F.round(x.cast("decimal(38,9)"), 6).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(dec) + F.lit(0.0)
