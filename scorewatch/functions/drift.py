"""Column expressions for binning and population stability (PSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.values import PROPORTION_SUM_RANGE, PSI_FLOOR

# Up to this many edges the bucket is found by plain comparisons, which stay
# inside generated code; a lambda over the array is slower, but has no limit.
UNROLL_EDGES = 32

# Text that counts as a number: digits may be grouped by "_", no "d" / "f"
# suffix, no hexadecimal.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_NAN = r"(?i)^\s*[+-]?nan\s*$"


def bucketize(value: Column, bins: Column, max_edges: int | None = None) -> Column:
    """Zero-based bucket of ``value`` between ascending edges ``bins``.

    A value on an edge belongs to the bucket above it; values outside the edges
    (and NaN, which sorts above everything) go to the nearest end bucket. NULL
    gives NULL. ``max_edges`` is the longest ``bins`` in the table if known.
    """
    last = F.size(bins) - 2
    if max_edges is not None and max_edges <= UNROLL_EDGES:
        passed = F.lit(0)
        for i in range(1, max_edges - 1):
            passed = passed + F.when(F.get(bins, F.lit(i)) <= value, 1).otherwise(0)
    else:
        passed = F.size(F.filter(bins, lambda b: b <= value)) - 1
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(last, passed)))


def psi(expected: Column, actual: Column) -> Column:
    """PSI of two proportion arrays of equal length, rounded to 4 digits.

    The sum runs in bucket order, so the same input always gives the same float.
    """
    def term(e: Column, a: Column) -> Column:
        e, a = F.greatest(e, F.lit(PSI_FLOOR)), F.greatest(a, F.lit(PSI_FLOOR))
        return (a - e) * F.log(a / e)

    total = F.aggregate(F.zip_with(expected, actual, term), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(
        F.size(expected) != F.size(actual),
        F.raise_error(F.lit("expected and actual must have the same number of buckets")).cast("double"),
    ).otherwise(F.round(total, 4))


def proportions(counts: Column, buckets: Column, total: Column) -> Column:
    """Shares per bucket from a map bucket -> count; absent buckets count as 0."""
    return F.transform(
        F.sequence(F.lit(0), buckets - 1),
        lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0)) / total,
    )


def may_be_number(data_type: T.DataType) -> bool:
    """Whether values of a type can count as numbers at all."""
    return isinstance(data_type, (T.NumericType, T.BooleanType, T.StringType))


def as_number(column: Column, data_type: T.DataType) -> Column:
    """``column`` as double, NULL where it is not a number.

    Numbers and booleans convert, text is parsed, every other type (dates,
    timestamps, binary, nested) never counts as a number.
    """
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(data_type, T.StringType):
        text = F.regexp_replace(column, r"[\s_]", "")
        return (
            F.when(column.rlike(_NUMBER) | column.rlike(_INFINITE), text.try_cast("double"))
            .when(column.rlike(_NAN), F.lit(float("nan")))
        )
    return F.lit(None).cast("double")


def baseline_errors(bins: Column, props: Column) -> Column:
    """What is wrong with a baseline, as an array of messages (empty when fine)."""
    low, high = PROPORTION_SUM_RANGE
    total = F.aggregate(props, F.lit(0.0), lambda acc, x: acc + x)
    return F.filter(
        F.array(
            F.when(F.size(bins) < 3, "needs at least 3 bin edges"),
            F.when(F.size(props) != F.size(bins) - 1, "needs one proportion per bucket"),
            F.when(F.exists(props, lambda p: p < 0), "has a negative proportion"),
            F.when(~total.between(low, high), "proportions do not sum to 1"),
            F.when(F.array_sort(bins) != bins, "edges are not in ascending order"),
        ),
        lambda e: e.isNotNull(),
    )
