"""One-row results as constants of another plan."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result as literals (nulls if there is no row): no join is planned, and filters on them reach
    the scan. The row is computed at once."""
    row = one_row.first()
    for f in one_row.schema:
        df = df.withColumn(f.name, F.lit(row[f.name] if row else None).cast(f.dataType))
    return df
