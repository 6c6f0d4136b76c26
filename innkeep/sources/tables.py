"""Sources and sinks (A1-A4).

* :func:`load_tables` - the bookings tables derived from the driver tables in
  one directory (one Parquet file per driver table).
* :func:`read_tables` - already-loaded bookings tables, read with their
  declared schema (no inference).
* :func:`bulk_load` - typed CSV/JSON initial rows -> quality checks -> Parquet;
  :func:`load_lines` the same on a text column.
* :func:`read_changes` - JSON change requests, unreadable records kept aside;
  :func:`parse_changes` the same on a text column.
* :func:`write_report` - result rows out as JSON / Parquet / CSV, in order if
  asked; :func:`report_lines` as a JSON text column.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .adapter import hotel_tables
from .schema import SPECS, TableSpec

DRIVER_TABLES = "region nation customer supplier part orders lineitem events documents".split()


_DERIVED: dict[tuple, dict[str, DataFrame]] = {}


def read_driver_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Lazy readers for the driver's Parquet tables; a missing table raises."""
    return {name: spark.read.parquet(os.path.join(directory, f"{name}.parquet")) for name in DRIVER_TABLES}


def _version(spark: SparkSession, directory: str) -> tuple:
    """Names, sizes and times of the files under the tables, from the file system that Spark reads."""
    out = []
    for name in DRIVER_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(directory, f"{name}.parquet"))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        out.append((name, *[(f.getLen(), f.getModificationTime()) for f in files or []]))
    return tuple(out)


def load_tables(spark: SparkSession, directory: str, refresh: bool = False) -> dict[str, DataFrame]:
    """A1: the 13 bookings tables (lazy DataFrames) derived from ``directory``.

    Readers and row counts are kept for the session while the tables' files
    stay as they are; ``refresh`` reads them again in any case.
    """
    handle = getattr(spark, "_jsparkSession", None)
    if handle is None:  # Spark Connect: nothing is kept
        raw = read_driver_tables(spark, directory)
        return hotel_tables(raw, {t: raw[t].count() for t in ("part", "customer", "supplier")})
    key = id(handle), directory
    version = _version(spark, directory)
    if refresh or _DERIVED.get(key, (None,))[0] != version:
        raw = read_driver_tables(spark, directory)
        # three row counts: Parquet answers them from the footers
        sizes = {t: raw[t].count() for t in ("part", "customer", "supplier")}
        _DERIVED.clear()  # one set of tables is kept
        _DERIVED[key] = version, hotel_tables(raw, sizes)
    return _DERIVED[key][1]


def read_tables(
    spark: SparkSession, directory: str, id_type: T.DataType | None = None, names: list[str] | None = None
) -> dict[str, DataFrame]:
    """Bookings tables stored as ``<directory>/<table>`` Parquet, declared schema.

    All tables, or those in ``names``; one that isn't there raises.
    """
    return {
        name: spark.read.schema(SPECS[name].struct(id_type)).parquet(os.path.join(directory, name))
        for name in (names or SPECS)
    }


# stored layout: tables whose date filters should prune folders at the scan
PARTITIONS = {"event": ["EventDate"]}


def write_tables(
    T: dict[str, DataFrame], directory: str, mode: str = "errorifexists", partitions: dict | None = None
) -> None:
    """Store bookings tables as ``<directory>/<table>`` Parquet (the layout
    :func:`read_tables` reads).

    ``partitions`` (default :data:`PARTITIONS`) names partition columns per
    table: events are stored by ``EventDate``, so ``EventDate >= as_of``
    (C6, B9, D7) reads only the folders on or after that day.  Each task
    writes its own files; nothing passes through the driver.
    """
    parts = PARTITIONS if partitions is None else partitions
    for name, df in T.items():
        writer = df.write.mode(mode)
        if parts.get(name):
            writer = writer.partitionBy(*parts[name])
        writer.parquet(os.path.join(directory, name))


CORRUPT = "_corrupt_record"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
CSV_OPTIONS = {**PERMISSIVE, "escape": '"'}  # a quote in a quoted field is doubled


def _readable(spec: TableSpec, id_type: T.DataType | None) -> T.StructType:
    """The declared columns, each NULL where it does not parse, and the text of records that don't parse."""
    fields = [T.StructField(f.name, f.dataType, True) for f in spec.struct(id_type).fields]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType(), True)])


def accept_rows(rows: DataFrame, table: str, parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed rows (with the text of records that did not parse) -> ``(rows that pass, violations)``.

    Violations are those of the quality job (J) and every record that did not
    parse, with its text (rule ``unreadable``).  A row with a violation, or
    with a repeated key, does not pass, as the database would refuse it.
    ``parents`` adds the foreign-key check (J5) against them.
    """
    from ..operators.quality import RULE_BUILDERS, _key, _union, check_foreign_keys, check_table

    spec, none = SPECS[table], F.lit(None).cast("string")
    unreadable = rows.where(F.col(CORRUPT).isNotNull()).select(
        F.lit(table).alias("table_name"), F.lit("unreadable").alias("rule"), none.alias("column_name"), none.alias("row_key"), F.col(CORRUPT).alias("bad_value")
    )
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    found = [check_table(good, spec), unreadable]
    passing = good
    for name in RULE_BUILDERS:
        for _, _, bad in RULE_BUILDERS[name](good, spec):
            passing = passing.where(~F.coalesce(bad, F.lit(False)))
    repeated = good.groupBy(*spec.key).count().where("count > 1").select(*spec.key)
    passing = passing.join(repeated, list(spec.key), "left_anti")
    if parents:
        missing = check_foreign_keys({**parents, table: good}, spec)
        found += missing
        for m in missing:
            passing = passing.join(m.select(F.col("row_key").alias("__bad")).distinct(), _key(spec) == F.col("__bad"), "left_anti")
    return passing.select(*[c.name for c in spec.columns]), _union(found, rows.sparkSession)


def load_lines(
    lines: DataFrame, table: str, column: str = "line", fmt: str = "csv", id_type: T.DataType | None = None, parents: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """A2 on a column: CSV or JSON text, one record a row -> ``(rows that pass, violations)``.

    The same rules as :func:`bulk_load`, for text that Spark already holds (a
    message queue, an archive's contents).  Blank lines and NULLs are skipped, as file readers do.
    """
    from ..session import stage

    schema, text = _readable(SPECS[table], id_type), F.col(column)
    parsed = F.from_csv(text, schema.toDDL(), CSV_OPTIONS) if fmt == "csv" else F.from_json(text, schema, PERMISSIVE)
    rows = lines.where(F.trim(text) != "").select(parsed.alias("r")).select("r.*")
    return accept_rows(stage(rows), table, parents)


def bulk_load(
    spark: SparkSession,
    table: str,
    path: str,
    out_path: str,
    fmt: str = "csv",
    id_type: T.DataType | None = None,
    mode: str = "errorifexists",
    parents: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """A2: read initial rows with the declared schema, check them, write the rows that pass as Parquet.

    Returns the violations of :func:`accept_rows`; ``parents`` are the
    already-loaded tables (e.g. from :func:`read_tables`).
    """
    from ..session import stage

    reader = spark.read.schema(_readable(SPECS[table], id_type))
    rows = stage(reader.options(**CSV_OPTIONS, header=True).csv(path) if fmt == "csv" else reader.options(**PERMISSIVE).json(path))
    passing, violations = accept_rows(rows, table, parents)
    passing.write.mode(mode).parquet(out_path)
    return violations


MALFORMED = "malformed record"
BODY = "body"


def parse_changes(lines: DataFrame, schema: T.StructType | str, column: str = "line", keep_body: bool = False) -> tuple[DataFrame, DataFrame]:
    """A3 on a column: JSON change requests, one a row, with an explicit schema.

    Returns ``(good, bad)``.  ``bad`` has the ``raw`` text and the ``reason``:
    ``malformed record`` for text that is no JSON object (NULL and blank text too),
    ``type: <field>`` for the first declared field whose value its type can't hold
    (text for a number, a number too wide).  What follows a whole object is
    ignored, as Spark's file reader does.  ``keep_body`` adds the text of the good ones as ``body``:
    the jobs' rejects carry every feed column, so they then show each request as
    it was sent (a JSON number ``5`` and a JSON text ``"5"`` stay apart).
    """
    from ..session import stage

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = F.col(column)

    def parsed(fields: list[T.StructField]):
        return F.from_json(text, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField(CORRUPT, T.StringType(), True)]), PERMISSIVE)

    rows = stage(lines.select(text.alias(column), parsed(schema.fields).alias("r")))
    broken = F.col("r").isNull() | (F.trim(text) == "") | F.col(f"r.{CORRUPT}").isNotNull()
    good = rows.where(~broken).select(*[F.col(f"r.{f.name}") for f in schema.fields], *([text.alias(BODY)] if keep_body else []))
    unlike = [F.when(parsed([f]).getField(CORRUPT).isNotNull(), F.lit(f"type: {f.name}")) for f in schema.fields]
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    reason = F.when(~is_object, F.lit(MALFORMED)).otherwise(F.coalesce(*unlike, F.lit(MALFORMED)))
    return good, rows.where(broken).select(text.alias("raw"), reason.alias("reason"))


def read_changes(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """A3: JSON change requests of files, one a line, with an explicit schema (a StructType or DDL,
    e.g. ``innkeep.operators.changes.FEEDS["checkout_and_bill"]``).

    Returns ``(good, bad)`` of :func:`parse_changes`; blank lines are skipped.
    No request is silently dropped.
    """
    return parse_changes(spark.read.text(path).where(F.trim("value") != ""), schema, "value")


def report_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """A4 on a column: every result row as JSON text, NULL fields as null, times without a zone."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias(column))


JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "ignoreNullFields": "false"}


def write_report(
    df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", partition_by: list[str] | None = None,
    order_by: list[Column | str] | None = None,
) -> None:
    """A4: emit result rows (JSON lines by default, one file per partition).

    ``order_by`` writes one global order: rows are dealt to tasks by range and
    sorted within each, so the files, by name, one after the other, are the
    sorted report (F).  With ``partition_by`` that holds within each folder.

    ``partition_by`` writes one folder per value (e.g. a date column) so
    readers prune whole folders; each task writes its own files, nothing
    passes through the driver.
    """
    if order_by:
        df = df.orderBy(*(partition_by or []), *order_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "json":
        # NULL fields are written as null, as the model's JSON responses carry them
        writer.options(**JSON_OPTIONS).json(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
