"""Table-valued functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_window_ids(spark: SparkSession, name: str = "window_ids") -> None:
    """``name(t, width, step)``: the windows of ``width`` samples every ``step`` that contain sample ``t``, as a SQL table function.

    In DataFrames ``windows.slide`` does the same.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(t BIGINT, width BIGINT, step BIGINT) RETURNS TABLE (win BIGINT)
        RETURN SELECT w FROM (SELECT explode(sequence(greatest(CAST(ceil((t - width + 1) / step) AS BIGINT), 0), greatest(t div step, 0))) AS w)
        WHERE w * step <= t AND t < w * step + width""")
