"""The scalar helpers as SQL functions: plain expressions, so the optimizer inlines them."""
from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (parameters, return type, expression)
SQL_FUNCTIONS = {
    "fg_collapse": ("x STRING", "STRING", r"trim(regexp_replace(x, '(?U)[\\s\\x1c-\\x1f]+', ' '))"),
    "fg_text": ("x STRING", "STRING", r"replace(replace(lower(trim(regexp_replace(x, '(?U)[\\s\\x1c-\\x1f]+', ' '))), 'ß', 'ss'), 'ς', 'σ')"),
    "fg_number": ("x STRING", "DECIMAL(38,10)", r"try_cast(trim(regexp_replace(x, '[,$]', '')) AS DECIMAL(38,10))"),
    "fg_confidence": ("x DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(x) AND x BETWEEN 0 AND 1 THEN x END"),
    "fg_canonical": ("x STRING", "STRING", "to_json(try_parse_json(x))"),
    "fg_digest": ("x STRING", "STRING", "sha2(to_json(try_parse_json(x)), 256)"),
    "fg_currency": ("x STRING", "STRING",
                    "CASE WHEN upper(trim(x)) IN ('$', 'US$') THEN 'USD' WHEN upper(trim(x)) = '€' THEN 'EUR' WHEN upper(trim(x)) = '£' THEN 'GBP' "
                    "WHEN upper(trim(x)) = '¥' THEN 'JPY' WHEN upper(trim(x)) RLIKE '^[A-Z]{3}$' THEN upper(trim(x)) WHEN contains(x, '$') THEN 'USD' "
                    "WHEN contains(x, '€') THEN 'EUR' WHEN contains(x, '£') THEN 'GBP' ELSE lower(trim(x)) END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions in a session and return their names."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(SQL_FUNCTIONS)
