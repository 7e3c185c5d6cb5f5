"""One SQL text for Spark and for the DuckDB oracle: a few macros stand for what differs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SPARK = {
    "pct": "percentile({0}, {1})",
    "agg": "array_join(array_sort(collect_list({0})), {1})",
    "dot": "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)",
    "range": "(select cast(id as bigint) as i from range({0}))",
    "tokens": "explode(regexp_extract_all(lower({0}), '[a-z]+', 0))",
    "k": "cast(get_json_object({0}, '$.k') as bigint)",
}
_DUCK = {
    "pct": "quantile_cont({0}, {1})",
    "agg": "string_agg({0}, {1} order by {0})",
    "dot": "list_inner_product(cast({0} as double[]), cast({1} as double[]))",
    "range": "(select cast(range as bigint) as i from range({0}))",
    "tokens": "unnest(regexp_extract_all(lower({0}), '[a-z]+'))",
    "k": "cast(json_extract_string({0}, '$.k') as bigint)",
}


def _expand(sql: str, macros: dict[str, str]) -> str:
    """Replace ``@name(a; b)``, innermost first."""
    pattern = re.compile(r"@(\w+)\(((?:[^@()]|\([^@()]*(?:\([^@()]*\)[^@()]*)*\))*)\)")
    while m := pattern.search(sql):
        args = [a.strip() for a in m[2].split(";")]
        sql = sql[: m.start()] + macros[m[1]].format(*args) + sql[m.end() :]
    return sql


def run_sql(spark: SparkSession, sql: str, **inputs: DataFrame) -> DataFrame:
    """The plan of ``sql`` over ``{name}`` inputs."""
    text = _expand(sql, _SPARK)
    used = {k: v for k, v in inputs.items() if "{" + k + "}" in text}
    return spark.sql(text, **used)


def duck_sql(sql: str, **inputs: str) -> str:
    """The oracle's text: inputs are SQL too."""
    text = _expand(sql, _DUCK)
    for _ in range(3):
        for k, v in inputs.items():
            text = text.replace("{" + k + "}", f"({v})" if " " in v else v)
    return _expand(text, _DUCK)
