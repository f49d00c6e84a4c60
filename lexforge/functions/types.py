"""Types of Python functions as objects, so that modules can be imported before there is a session."""

from pyspark.sql import types as T

STRING, BOOLEAN, LONG, DOUBLE = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def small_batches(spark) -> None:
    """Arrow batches of bounded size, so that a Python worker's memory follows neither the rows of a task nor the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
