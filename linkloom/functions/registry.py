"""Functions for Spark SQL: the same column functions under names, and parameters in their text form."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: parameters and body of a temporary SQL function.
SQL_FUNCTIONS = {
    "motif_count": ("seq STRING, motif STRING", "BIGINT", "CAST((length(lower(seq)) - length(replace(lower(seq), lower(motif), ''))) / length(motif) + 1 AS BIGINT)"),
    "reverse_complement": ("seq STRING", "STRING", "reverse(translate(seq, 'ATCGNatcgn', 'TAGCNtagcn'))"),
    "pair_key": ("a STRING, b STRING", "STRUCT<a: STRING, b: STRING>", "named_struct('a', least(a, b), 'b', greatest(a, b))"),
    "contig_half": ("pos BIGINT, len BIGINT", "STRING", "CASE WHEN 2 * pos > len THEN 'T' ELSE 'H' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session's SQL; returns their names."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)


def threshold(text: str, statistic: float) -> float:
    """`1.9X` is that multiple of a statistic, `0.3` the number itself; a negative or empty one is an error."""
    value = float(text[:-1]) * statistic if text[-1:] in "xX" and text else float(text)
    if value < 0:
        raise ValueError(f"{text} is below zero")
    return value
