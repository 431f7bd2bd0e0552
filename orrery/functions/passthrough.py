"""SQL templates with `{0}`, `{1}` placeholders, and reusable named SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

_TYPES = {
    "string": "string", "int": "bigint", "double": "double",
    "bool": "boolean", "date": "date", "date_time": "timestamp",
}


def _fill(template: str, columns: tuple[str, ...]) -> str:
    """Put quoted column names into the placeholders."""
    wanted = {int(i) for i in re.findall(r"\{(\d+)\}", template)}
    if wanted != set(range(len(columns))):
        raise ValueError(f"template uses placeholders {sorted(wanted)}, {len(columns)} columns given")
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return re.sub(r"\{(\d+)\}", lambda m: quoted[int(m.group(1))], template)


def sql_scalar_op(kind: str, template: str, *columns: str) -> Column:
    """A row-level SQL expression of the declared kind over named columns."""
    return F.expr(_fill(template, columns)).cast(_TYPES[kind])


def sql_aggregate_op(kind: str, template: str, *columns: str) -> Column:
    """The same for an expression that aggregates, for use in `agg`."""
    return F.expr(_fill(template, columns)).cast(_TYPES[kind])


def register_sql_udf(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A named SQL expression usable from `spark.sql` and `expr`; Spark inlines it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


# Bodies of the duration functions; the date and duration modules hold the column forms.
DURATION_UDFS = {
    "hours_minutes": (
        "m BIGINT", "STRING",
        "concat(lpad(CAST(m DIV 60 AS STRING), greatest(2, length(CAST(m DIV 60 AS STRING))), '0'), ':', "
        "lpad(CAST(m % 60 AS STRING), 2, '0'))",
    ),
    "weekday_days": (
        "a DATE, b DATE", "INT",
        "datediff(b, a) - 2 * CAST(floor((unix_date(b) + 3) / 7) - floor((unix_date(a) + 3) / 7) AS INT)",
    ),
}


def register_duration_udfs(spark: SparkSession) -> None:
    for name, (params, returns, body) in DURATION_UDFS.items():
        register_sql_udf(spark, name, params, returns, body)
