"""Constraint checks as a data-quality job.

Every check returns violations in one shape::

    table_name, rule, column_name, row_key, bad_value   (all strings)

Per-row rules (NOT NULL, value list, range, size, stay order) are evaluated
in **one scan per table**: each row yields the array of rules it breaks,
and only offending rows are exploded.  Uniqueness is a grouped count
(partial aggregation collapses a hot key map-side).  Foreign keys reduce the
child's key column to its distinct values first, anti-join those to the
parent, and only then pick the offending child rows with a semi join - the
big child table is never shuffled against the parent row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.schema import SPECS, TableSpec

VIOLATION_COLUMNS = ["table_name", "rule", "column_name", "row_key", "bad_value"]


def _key(spec: TableSpec) -> Column:
    cols = [F.col(k).cast("string") for k in spec.key]
    return cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)


def _union(frames: list[DataFrame], spark) -> DataFrame:
    if not frames:
        schema = ", ".join(f"{c} string" for c in VIOLATION_COLUMNS)
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, frames)


def _row_rules(df: DataFrame, spec: TableSpec, rules: list[tuple[str, str, Column]]) -> DataFrame | None:
    """rules: (rule, column, violated-predicate). One pass; explode offenders only."""
    if not rules:
        return None
    hits = F.filter(
        F.array(
            *[
                F.when(pred, F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column_name"),
                                      F.col(col).cast("string").alias("bad_value")))
                for rule, col, pred in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    any_hit = reduce(lambda a, b: a | b, [F.coalesce(pred, F.lit(False)) for _, _, pred in rules])
    return (
        df.where(any_hit)
        .select(_key(spec).alias("row_key"), F.explode(hits).alias("v"))
        .select(
            F.lit(spec.name).alias("table_name"),
            "v.rule",
            "v.column_name",
            "row_key",
            "v.bad_value",
        )
    )


def check_unique(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys that occur more than once (one row per duplicated key, count as value)."""
    keys = list(spec.key)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(
            F.lit(spec.name).alias("table_name"),
            F.lit("unique").alias("rule"),
            F.lit(",".join(keys)).alias("column_name"),
            _key(spec).alias("row_key"),
            F.col("n").cast("string").alias("bad_value"),
        )
    )


def not_null_rules(df: DataFrame, spec: TableSpec):
    return [("not_null", c.name, F.col(c.name).isNull()) for c in spec.columns if not c.nullable and c.name in df.columns]


def enum_rules(df: DataFrame, spec: TableSpec):
    return [
        ("enum", c.name, F.col(c.name).isNotNull() & ~F.col(c.name).isin(*c.values))
        for c in spec.columns
        if c.values and c.name in df.columns
    ]


def range_rules(df: DataFrame, spec: TableSpec):
    return [
        ("range", c.name, F.col(c.name).isNotNull() & ~F.col(c.name).between(*c.between))
        for c in spec.columns
        if c.between and c.name in df.columns
    ]


def size_rules(df: DataFrame, spec: TableSpec):
    """VARCHAR length on string columns; DECIMAL precision on declared decimals."""
    out = []
    for c in spec.columns:
        if c.name not in df.columns:
            continue
        actual = df.schema[c.name].dataType
        if c.max_len and isinstance(actual, T.StringType):
            out.append(("size", c.name, F.length(c.name) > c.max_len))
        if isinstance(c.dtype, T.DecimalType):
            limit = 10 ** (c.dtype.precision - c.dtype.scale)
            out.append(("size", c.name, F.abs(F.col(c.name)) >= F.lit(limit)))
    return out


def stay_order_rules(df: DataFrame, spec: TableSpec):
    """Check-out, when present, must be after check-in (reservations)."""
    if spec.name != "reservation":
        return []
    return [("stay_order", "CheckOut", F.col("CheckOut").isNotNull() & (F.col("CheckOut") <= F.col("CheckIn")))]


RULE_BUILDERS = {
    "not_null": not_null_rules,
    "enum": enum_rules,
    "range": range_rules,
    "size": size_rules,
    "stay_order": stay_order_rules,
}


def check_rows(df: DataFrame, spec: TableSpec, rules=("not_null", "enum", "range", "size", "stay_order")):
    """J2, J3, J4, J6, J7 over one table in a single scan."""
    preds = [r for name in rules for r in RULE_BUILDERS[name](df, spec)]
    return _row_rules(df, spec, preds)


def check_foreign_keys(T_: dict[str, DataFrame], spec: TableSpec) -> list[DataFrame]:
    """Non-NULL foreign key values missing from the parent table.

    All keys of a child go together as (column, value) rows: one scan for the
    distinct values, one for the rows that hold a missing one.
    """
    if not spec.foreign_keys:
        return []
    child = T_[spec.name]
    pairs = [F.struct(F.lit(k.column).alias("c"), F.col(k.column).cast("string").alias("v")) for k in spec.foreign_keys]
    held = child.select(_key(spec).alias("row_key"), F.explode(F.array(*pairs)).alias("_p")).select("row_key", "_p.c", "_p.v").where("v is not null")
    parents = None
    for k in spec.foreign_keys:
        keys = T_[k.parent].select(F.lit(k.column).alias("c"), F.col(k.parent_column).cast("string").alias("v"))
        parents = keys if parents is None else parents.unionAll(keys)
    missing = held.select("c", "v").distinct().join(parents, ["c", "v"], "left_anti")
    bad = held.join(missing, ["c", "v"], "left_semi")
    return [
        bad.select(
            F.lit(spec.name).alias("table_name"),
            F.lit("foreign_key").alias("rule"),
            F.col("c").alias("column_name"),
            "row_key",
            F.col("v").alias("bad_value"),
        )
    ]


@dataclass(frozen=True)
class Delta:
    """What a batch did to one table: whole rows put in or replaced, and keys taken out."""

    upserted: DataFrame | None = None
    removed: DataFrame | None = None


def _texts(df: DataFrame | None, column: str, name: str) -> DataFrame | None:
    return None if df is None else df.select(F.col(column).cast("string").alias(name))


def refresh_foreign_keys(previous: DataFrame, T_: dict[str, DataFrame], deltas: dict[str, Delta]) -> DataFrame:
    """J5 from changes only: the violations after a batch, from those before it.

    ``T_`` are the tables after the batch, ``deltas`` what it did to them.
    Equals :func:`check_all` of the foreign-key rule, but reads

    * the batch's rows and the parents' keys for values that came in;
    * a child's key columns only where keys were taken out of its parent, joined
      with those keys.

    A violation ends where its row was replaced or taken out, or its parent came in.
    """
    frames = [previous]
    ended = []  # keys of violations that end
    for name, spec in SPECS.items():
        if not spec.foreign_keys:
            continue
        delta = deltas.get(name, Delta())
        touched = None
        for part in (delta.upserted, delta.removed):
            if part is not None:
                keys = part.select(_key(spec).alias("row_key"))
                touched = keys if touched is None else touched.unionAll(keys)
        if touched is not None:
            ended.append(touched.select(F.lit(name).alias("table_name"), "row_key").distinct())
        if delta.upserted is not None:
            frames += check_foreign_keys({**T_, name: delta.upserted}, spec)
        for fk in spec.foreign_keys:
            parent = deltas.get(fk.parent, Delta())
            came = _texts(parent.upserted, fk.parent_column, "bad_value")
            if came is not None:
                ended.append(came.select(F.lit(name).alias("table_name"), F.lit(fk.column).alias("column_name"), "bad_value").distinct())
            gone = _texts(parent.removed, SPECS[fk.parent].key[0], "bad_value")
            if gone is not None:
                gone = gone.distinct().join(_texts(T_[fk.parent], fk.parent_column, "bad_value"), "bad_value", "left_anti")
                held = T_[name].select(_key(spec).alias("row_key"), F.col(fk.column).cast("string").alias("bad_value"))
                left = held.join(gone, "bad_value", "left_semi")
                if touched is not None:  # these rows have been checked whole
                    left = left.join(touched, "row_key", "left_anti")
                frames.append(left.select(F.lit(name).alias("table_name"), F.lit("foreign_key").alias("rule"), F.lit(fk.column).alias("column_name"), "row_key", "bad_value"))
    for keys in ended:
        frames[0] = frames[0].join(keys, keys.columns, "left_anti")
    return _union([f.select(*VIOLATION_COLUMNS) for f in frames], previous.sparkSession)


def check_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """All single-table rules (J1-J4, J6, J7) for one table."""
    frames = [check_unique(df, spec)]
    rows = check_rows(df, spec)
    if rows is not None:
        frames.append(rows)
    return _union(frames, df.sparkSession)


def check_all(T_: dict[str, DataFrame], rules: tuple[str, ...] = ("unique", "not_null", "enum", "range",
                                                                   "size", "foreign_key", "stay_order")) -> DataFrame:
    """Run the chosen rules over every bookings table present in ``T_``."""
    frames: list[DataFrame] = []
    row_rules = tuple(r for r in rules if r in RULE_BUILDERS)
    spark = None
    for name, spec in SPECS.items():
        if name not in T_:
            continue
        df = T_[name]
        spark = df.sparkSession
        if "unique" in rules:
            frames.append(check_unique(df, spec))
        if row_rules:
            rows = check_rows(df, spec, row_rules)
            if rows is not None:
                frames.append(rows)
        if "foreign_key" in rules:
            frames.extend(check_foreign_keys(T_, spec))
    return _union(frames, spark)


def summary(violations: DataFrame) -> DataFrame:
    """Violation counts per table, rule and column (one partial aggregate)."""
    return (
        violations.groupBy("table_name", "rule", "column_name")
        .agg(F.count(F.lit(1)).alias("violations"))
        .orderBy("table_name", "rule", "column_name")
    )
