"""Return types of the Arrow kernels, usable before a session exists."""

from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
LONGS = T.ArrayType(T.LongType())


def doubles(*names: str) -> T.StructType:
    """A struct of double arrays."""
    return T.StructType([T.StructField(n, DOUBLES) for n in names])
