"""Column expressions: calendar, meteorological, risk and NULL handling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, BooleanType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every source turns floating NaN into NULL so operators only see NULL."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (non-boolean) columns in schema order, minus exclusions."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in ex]


def scalars(stats: DataFrame) -> dict:
    """Fit step: compute a ONE-row statistics table (one job, like an ML
    ``fit``) and inline its values as typed literals (name -> Column).

    The row is bounded by the number of columns, so moving it to the driver is
    safe at any data size; the plan that applies it is a plain projection or
    filter with constants (no join with the data, no nested subqueries)."""
    return fit_row(stats)[1]


def fit_row(stats: DataFrame):
    """(Row, name -> literal Column) of a one-row statistics table."""
    row = stats.first()
    return row, {f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema.fields}
