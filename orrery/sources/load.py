"""Load: CSV folders and manifests, type inference over all rows, typed tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def sanitise_name(name: str) -> str:
    """Upper case, runs of other characters than A-Z and 0-9 to one `_`, none at the ends."""
    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def sanitise_columns(df: DataFrame) -> DataFrame:
    names = [sanitise_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide once cleaned: {names}")
    return df.toDF(*names)


def _read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text; empty cells are NULL.

    Files are split among tasks. Cells with line breaks need `multi_line`, which makes each
    file one task.
    """
    return sanitise_columns(spark.read.csv(path, header=True, multiLine=multi_line, escape='"', nullValue=""))


def _stem(path: str) -> str:
    return sanitise_name(os.path.splitext(os.path.basename(path))[0])


def _listing(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any file system that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(path))


def scan_csv_dir(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """One table per `*.csv` file or folder, named by its clean file name."""
    found = [p for p in _listing(spark, folder) if p.lower().endswith(".csv")]
    if not found:
        raise ValueError(f"no .csv files in {folder}")
    return {_stem(p): _read_csv(spark, p, multi_line) for p in found}


def scan_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame | dict]:
    """Tables of a JSON manifest.

    `{"data_files": [{"type": "csv", "path": ...}]}` lists files; `{"tables": [...]}`
    lists tables with `data_file`, or only a schema, which is then returned as it is
    for `generate_table`. An entry with `"multi_line": true` has cells with line breaks.
    """
    doc = json.loads("\n".join(r.value for r in spark.read.text(path).toLocalIterator()))
    # Both forms as (name, file or None, entry).
    entries = [(_stem(f["path"]), f["path"], f) for f in doc.get("data_files", []) if f.get("type") == "csv"]
    entries += [(t["table_name"], t.get("data_file"), t) for t in doc.get("tables", [])]
    if not entries:
        raise ValueError(f"{path} lists no CSV files and no tables")
    return {name: _read_csv(spark, file, entry.get("multi_line", False)) if file else entry for name, file, entry in entries}


# The texts by which a column is recognised.
BOOLEAN_TEXT = ("true", "false", "0", "1")
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?"
INTEGER_PATTERN = r"^[+-]?\d+$"
FLOAT_PATTERN = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def infer_types(df: DataFrame) -> DataFrame:
    """One row per column with the first type that every non-blank value fits, the values and the rows.

    A single aggregation over all rows, map-side combined; nothing is sampled. Each value
    is put into one class, with the likelier patterns tried first.
    """

    text = {n: F.trim(F.col(f"`{n}`").cast("string")) for n in df.columns}
    values = df.select(*[F.when(v != "", v).alias(f"v{i}") for i, v in enumerate(text.values())])

    def kind_of(v: Column) -> Column:
        return (
            F.when(v.rlike(INTEGER_PATTERN), "i").when(v.rlike(FLOAT_PATTERN), "f")
            .when(v.rlike(DATE_PATTERN), "d").when(v.rlike(TIMESTAMP_PATTERN), "t").when(v.isNotNull(), "s")
        )

    every = range(len(df.columns))
    classed = values.select(
        *[kind_of(F.col(f"v{i}")).alias(f"k{i}") for i in every],
        *[((F.length(f"v{i}") <= 5) & F.lower(F.left(f"v{i}", F.lit(5))).isin(*BOOLEAN_TEXT)).alias(f"b{i}") for i in every],
        *[F.length(f"v{i}").alias(f"l{i}") for i in every],
    )

    def summary(i: int) -> Column:
        k = F.col(f"k{i}")
        return F.struct(
            F.lit(df.columns[i]).alias("column_name"), F.count(k).alias("filled"), F.bool_and(f"b{i}").alias("b"),
            F.coalesce(F.max(f"l{i}"), F.lit(0)).alias("longest"), *[F.count(F.when(k == x, 1)).alias(x) for x in "ifdt"],
        )

    one = classed.agg(F.count("*").alias("rows"), *[summary(i).alias(f"c{i}") for i in every])
    seen = one.select("rows", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))
    all_are = lambda *k: reduce(lambda a, b: a + b, [F.col(x) for x in k]) == F.col("filled")
    wide = F.greatest(F.lit(256), F.ceil(F.col("longest") * 1.5))
    kind = (
        F.when(F.col("filled") == 0, "VARCHAR(256)").when(F.col("b"), "BOOLEAN").when(all_are("i"), "INTEGER")
        .when(all_are("i", "f"), "FLOAT").when(all_are("d"), "DATE").when(all_are("t"), "TIMESTAMP")
        .otherwise(F.concat(F.lit("VARCHAR("), wide.cast("string"), F.lit(")")))
    )
    return seen.select("column_name", kind.alias("inferred_type"), "filled", "rows")


REPORT = "table_name string, column_name string, position int, type string, declared boolean, filled long, rows long"


def source_types(tables: Mapping[str, DataFrame], declared: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Tables, columns, types and rows of a whole source in one report, a scan a table.

    `declared` holds types by table and column, whatever their case; they are kept, as `declared`, and all other
    types are inferred. A declared column that a table lacks is reported with neither values nor a position.
    """
    known = {t.lower(): {c.lower(): kind for c, kind in cols.items()} for t, cols in (declared or {}).items()}
    parts = []
    for name, df in tables.items():
        mine = known.get(name.lower(), {})
        held = {c.lower() for c in df.columns}
        place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i + 1)])
        kind = F.create_map(*[F.lit(x) for c in df.columns if c.lower() in mine for x in (c, mine[c.lower()])]) if held & mine.keys() else None
        given = F.try_element_at(kind, F.col("column_name")) if kind is not None else F.lit(None).cast("string")
        parts.append(infer_types(df).select(
            F.lit(name).alias("table_name"), "column_name", F.element_at(place, F.col("column_name")).alias("position"),
            F.coalesce(given, "inferred_type").alias("type"), given.isNotNull().alias("declared"), "filled", "rows"))
        lost = sorted(set(mine) - held)
        if lost:
            missing = df.sparkSession.createDataFrame([(name, c, None, mine[c], True, None, None) for c in lost], REPORT)
            parts.append(missing)
    return reduce(DataFrame.unionByName, parts)


# Names of other systems, as Spark's type parser knows them.
ALSO = {
    "bool": "boolean", "number": "decimal", "integer": "int", "datetime": "timestamp", "timestamptz": "timestamp",
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double",
}


def loaded_type(declared: str) -> str:
    """The Spark type that a declared column is loaded as: whole numbers as bigint, others as double."""
    name, args = re.fullmatch(r"([^(]*?)\s*(\(.*\))?", declared.strip().lower(), re.S).groups()
    name = next(iter(name.split()), "")
    name = ALSO.get(name, "timestamp" if name.startswith("timestamp_") else name)
    try:
        known = T.DataType.fromDDL(name + (args or "") if name in ("decimal", "numeric", "dec") else name)
    except ParseException:
        return "string"
    if isinstance(known, (T.BooleanType, T.DateType, T.TimestampType)):
        return known.typeName()
    if isinstance(known, T.IntegralType) or (isinstance(known, T.DecimalType) and known.scale == 0):
        return "bigint"
    return "double" if isinstance(known, T.NumericType) else "string"


def load_typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns to their types: '' is NULL, `true/1/yes/t` are true, other booleans false."""

    def typed(name: str) -> Column:
        v = F.col(f"`{name}`")
        v = F.when(v != "", v)
        kind = loaded_type(types.get(name, "STRING"))
        if kind == "boolean":
            out = F.lower(F.trim(v)).isin("true", "1", "yes", "t")
        elif kind == "string":
            out = v
        else:
            out = F.trim(v).try_cast(kind)
        return out.alias(name)

    return df.select(*[typed(n) for n in df.columns])


def profile_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def load_table(
    df: DataFrame, name: str, if_exists: str = "error", partition_by: Sequence[str] = (), path: str | None = None
) -> int:
    """Write a table (at `path`, else in the warehouse) and return the rows it then holds.

    `if_exists` is error, skip or replace.
    """
    modes = {"error": "error", "skip": "ignore", "replace": "overwrite"}
    if if_exists not in modes:
        raise ValueError(f"if_exists is one of {sorted(modes)}")
    spark = df.sparkSession
    if not (if_exists == "skip" and spark.catalog.tableExists(name)):
        writer = df.write.mode(modes[if_exists])
        writer = writer.option("path", path) if path else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return spark.table(name).count()
