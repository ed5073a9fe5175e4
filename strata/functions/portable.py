"""Engine-neutral output types for comparing results with an independent SQL engine.

Decimals become their exact plain text (both engines print every scale digit), dates ISO text,
timestamps ``yyyy-MM-dd HH:mm:ss.ffffff`` text, every integer a bigint and every float a double.
Applied only at the edge of a query, after all the work is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("string")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_FORMAT)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(cols)
