"""Bulk change jobs (I1-I21): the write rules of the bookings model, set-wise.

Common shape: ``job(T, changes, ...) -> (new_tables, rejects)``.

* ``changes`` is a DataFrame of requested changes (the JSON body fields of
  the model's endpoint, snake_case) with a ``change_seq`` column: a unique,
  positive number that orders the changes as the model would apply them one
  at a time.
* ``new_tables`` holds only the tables the job changes; merge with
  ``{**T, **new_tables}``.
* ``rejects`` has the input columns plus ``reason``, one row per refused
  change, so nothing is dropped silently.

How the jobs are planned (and why they hold at scale):

* Every rule is a column predicate; one projection computes the *first*
  failing rule of each change (``reason``), so a batch is judged in one pass.
* Key and foreign-key lookups are left joins against the parent's key column
  with a presence flag.  Spark picks broadcast or sort-merge at run time
  (AQE) from the real sizes; nothing is broadcast by hand.
* "Last change wins" is ``groupBy(key).agg(max_by(struct, change_seq))`` and
  "first change wins" a ``groupBy(key).agg(min(change_seq))`` joined back:
  both aggregate map-side first, so a key that carries a third of the batch is
  collapsed before the shuffle instead of being sorted in one task.
* New identifiers are ``max(existing) + change_seq`` (I21): no global
  ``row_number`` (that would be one task), no driver round trip.
* A new table is the old one with changed rows replaced (left join on the
  key) or new rows appended (``unionByName``): the plan a table format's MERGE
  would run.

Where one change fails part-way in the model (its statements autocommit one by
one), a change here is all or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import is_missing, kind_of, py_strip, split_name, stay_charge, stay_nights
from ..sources.schema import ROOM_STATUSES, SPECS, ForeignKey, TableSpec
from ..session import stage
from .quality import RULE_BUILDERS

Tables = dict[str, DataFrame]

SEQ = "change_seq"
IN = "_in"

# --- fixed values: reject reasons (the model's own message where it has one) ---
MISSING = "required field missing"
NOT_FOUND = "not found"
DUPLICATE = "duplicate key"
STAY_ORDER = "Check-out must be after check-in."
REQUEST_ORDER = "Check-out date must be after check-in date."
COMPLETED_DELETE = "Cannot delete a completed booking."
ROOM_DELETE = "Rooms cannot be deleted directly. Contact a front desk staff."
BAD_STATUS = "status must be 'Occupied' or 'Vacant'."
BAD_RATING = "rating must be an integer between 1 and 5."
BAD_PAYMENT = "payment must be a positive amount"
REFERENCED = "referenced by "
ALREADY = "Request has already been "
INVALID_DATE = "invalid date"
TOKEN_PREFIX = "AK-"
# --- end of fixed values --------------------------------------------------------


# --- fixed values: change-feed schemas (the endpoints' JSON body fields) -------
# Dates and times are text: ``try_cast`` reads both ISO forms ("T" or space),
# and a value that does not parse becomes a reject instead of a bad record.
FEEDS = {
    "add_customers": "change_seq long, customer_id string, fname string, lname string, phone string",
    "update_customers": "change_seq long, customer_id string, fname string, lname string, phone string",
    "book_stays": "change_seq long, reservation_id string, room_id string, customer_id string, staff_id string, "
                  "check_in string, check_out string",
    "checkout_and_bill": "change_seq long, reservation_id string, check_out string",
    "delete_stays": "change_seq long, reservation_id string",
    "set_room_status": "change_seq long, room_no string, status string",
    "submit_requests": "change_seq long, fname string, lname string, phone string, room_type string, "
                       "check_in string, check_out string, token string",
    "approve_requests": "change_seq long, token string, room_no string, staff_id string",
    "decline_requests": "change_seq long, token string, staff_id string",
    "record_payments": "change_seq long, invoice_no string, amount decimal(12,2)",
    "set_amount_paid": "change_seq long, invoice_no string, amount_paid decimal(10,2)",
    "create_invoices": "change_seq long, invoice_no string, reservation_id string, customer_id string, "
                       "amount_payable decimal(10,2), amount_paid decimal(10,2)",
    "onboard_staff": "change_seq long, staff_id string, fname string, lname string, full_name string, role string, "
                     "shift string, floor int",
    "remove_staff": "change_seq long, staff_id string",
    "remove_customers": "change_seq long, customer_id string",
    "add_rooms": "change_seq long, room_no string, room_type string, rate decimal(10,2), housekeeper_id string",
    "update_rooms": "change_seq long, room_no string, room_type string, rate decimal(10,2)",
    "block_room_deletes": "change_seq long, room_no string",
    "add_events": "change_seq long, event_id string, event_type string, event_date string, duration decimal(4,1), "
                  "host_id string, hall_id string",
    "add_halls": "change_seq long, hall_id string, name string, capacity int",
    "add_restaurants": "change_seq long, restaurant_id string, name string, seating_capacity int",
    "add_orders": "change_seq long, order_id string, customer_id string, restaurant_id string, invoice_id string, "
                  "order_details string",
    "add_feedback": "change_seq long, feedback_id string, customer_id string, rating string, comments string",
    "remove_feedback": "change_seq long, feedback_id string",
}
# --- end of fixed values --------------------------------------------------------


BAD_SEQ = "change_seq must be given, from 0 to below 10^15 and unique in the batch"

# ------------------------------------------------------------------- helpers


def _feed_cols(changes: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Required-field map (name -> truthiness class) from the feed's types."""
    return {n: kind_of(changes.schema[n].dataType) for n in names if n in changes.columns}


def _opt(changes: DataFrame, name: str, dtype: str | None = None) -> Column:
    """An optional feed column; NULL when the feed does not carry it."""
    if name in changes.columns:
        return F.col(name)
    return F.lit(None).cast(dtype or "string")


def _truthy_or_null(changes: DataFrame, name: str) -> Column:
    """``body.get(name) or None``: an optional field, falsy values become NULL."""
    if name not in changes.columns:
        return F.lit(None)
    return F.when(~is_missing(F.col(name), kind_of(changes.schema[name].dataType)), F.col(name))


def _pack(changes: DataFrame, columns: dict[str, Column], required: Iterable[str] = ()) -> DataFrame:
    """Keep the feed row whole in ``_in``; candidate table columns beside it.

    Feed names are snake_case and table names CamelCase, but Spark resolves
    names case-insensitively (``rating`` / ``Rating``), so the feed is nested.
    """
    req = _feed_cols(changes, required)
    missing = F.lit(False)
    for name, kind in req.items():
        missing = missing | is_missing(F.col(name), kind)
    absent = [n for n in required if n not in changes.columns]
    if absent:
        missing = F.lit(True)
    repeated = changes.groupBy(F.col(SEQ).alias("__again")).count().where("count > 1").select("__again")
    changes_in = changes.join(repeated, F.col(SEQ) == F.col("__again"), "left")
    return changes_in.select(
        F.struct(*[F.col(c) for c in changes.columns]).alias(IN),
        F.col(SEQ).alias("__seq"),
        # the order of changes and generated ids rest on the number: it is judged first
        F.when(F.col(SEQ).isNull() | (F.col(SEQ) < 0) | (F.col(SEQ) >= GIVEN_TOP) | F.col("__again").isNotNull(), F.lit(BAD_SEQ)).alias("reason"),
        missing.alias("__missing"),
        *[e.alias(n) for n, e in columns.items()],
    )


def _judge(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Set ``reason`` to the first violated rule, unless one is already set."""
    if not rules:
        return df if "reason" in df.columns else df.withColumn("reason", F.lit(None).cast("string"))
    first = F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in rules])
    if "reason" in df.columns:
        first = F.coalesce(F.col("reason"), first)
    return df.withColumn("reason", first)


def _present(df: DataFrame, parent: DataFrame, parent_key: str, column: str, flag: str) -> DataFrame:
    """Left-join a presence flag: ``flag`` is true when ``column`` is a key of ``parent``.

    The parent keys are made distinct first (an EXISTS test), so even a parent
    with a repeated key - the fault J1 reports - never multiplies the changes;
    the partial aggregate shares the join's partitioning.
    """
    k = f"__k{flag}"
    keys = parent.select(F.col(parent_key).alias(k)).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, F.col(column) == F.col(k), "left").drop(k)


def _first_in_batch(df: DataFrame, keys: list[str], reason) -> DataFrame:
    """Of the changes still valid, the first per key (by seq) stays; later ones get ``reason``.

    ``reason`` is a text or a Column computed on the joined row.
    """
    firsts = (
        df.where(F.col("reason").isNull())
        .groupBy(*keys)
        .agg(F.min("__seq").alias("__first"))
    )
    out = df.join(firsts, keys, "left")
    why = reason if isinstance(reason, Column) else F.lit(reason)
    later = F.col("reason").isNull() & (F.col("__seq") != F.col("__first"))
    return out.withColumn("reason", F.when(later, why).otherwise(F.col("reason"))).drop("__first")


def _latest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Last change per key: ``max_by(struct, seq)``, partial-aggregated map-side."""
    payload = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max_by(payload, F.col("__seq")).alias("__l")).select(*keys, "__l.*")


def _outcome(df: DataFrame, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split judged changes into valid rows and rejects (one staged scan)."""
    if not staged:
        df = stage(df)
    valid = df.where(F.col("reason").isNull()).drop("reason")
    rejects = df.where(F.col("reason").isNotNull()).select(f"{IN}.*", "reason")
    return valid, rejects


def _spec_rules(df: DataFrame, spec: TableSpec, skip_size: Iterable[str] = ()) -> list[tuple[Column, str]]:
    """The rules the database itself enforces on a row (strict mode).

    NOT NULL, value lists, ranges, VARCHAR / DECIMAL sizes and stay order,
    reusing the data-quality job's predicates.
    """
    skip = set(skip_size)
    out = []
    for rule in ("not_null", "enum", "range", "size", "stay_order"):
        for name, column, pred in RULE_BUILDERS[rule](df, spec):
            if rule == "size" and column in skip:
                continue
            text = STAY_ORDER if rule == "stay_order" else f"{name}: {column}"
            out.append((pred, text))
    return out


def _fk_rules(df: DataFrame, T_: Tables, spec: TableSpec, columns: Iterable[str] | None = None):
    """Flag every foreign key of ``spec`` against its parent; returns (df, rules)."""
    rules = []
    wanted = set(columns) if columns is not None else None
    for fk in spec.foreign_keys:
        if fk.column not in df.columns or (wanted is not None and fk.column not in wanted):
            continue
        flag = f"__fk_{fk.column}"
        df = _present(df, T_[fk.parent], fk.parent_column, fk.column, flag)
        rules.append((F.col(fk.column).isNotNull() & F.col(flag).isNull(), f"foreign_key: {fk.column}"))
    return df, rules


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    """Rows in ``like``'s column order and types (for ``unionByName``)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _replace(table: DataFrame, key: str, updates: DataFrame, columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` taken from ``updates`` where the key matches.

    ``updates`` has one row per key.  A match flag (not ``coalesce``) decides,
    so an update may set a column to NULL.
    """
    upd = updates.select(
        F.col(key).alias("__uk"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__u_{c}") for c in columns]
    )
    joined = table.join(upd, F.col(key) == F.col("__uk"), "left")
    out = []
    for f in table.schema.fields:
        if f.name in columns:
            out.append(F.when(F.col("__hit"), F.col(f"__u_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return joined.select(*out)


def _left_spread(rows: DataFrame, other: DataFrame, column: str, key: str) -> DataFrame:
    """Left join by ``column`` = ``key`` of rows that often have no value there.

    NULL meets nothing, but as a key it would bring all such rows to one task:
    they are dealt by a number from the whole row, beside 0 for all others.
    """
    left = rows.withColumn("__deal", F.when(F.col(column).isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    # 0 as well, but no literal, which Spark would take out of the join's keys
    right = other.withColumn("__to", F.pmod(F.xxhash64(key), F.lit(1)))
    return left.join(right, (F.col(column) == F.col(key)) & (F.col("__deal") == F.col("__to")), "left").drop("__deal", "__to")


def _null_where_in(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """ON DELETE SET NULL: ``column`` becomes NULL where it is one of ``ids``."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"), F.lit(True).alias("__hit"))
    joined = _left_spread(table, gone, column, "__gone")
    return joined.select(
        *[
            F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
            if c == column
            else F.col(c)
            for c in table.columns
        ]
    )


def _drop_keys(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


# --------------------------------------------------------------------- I21 ids


# Numbers are kept apart, so that no id or change number can bring another batch to a stop:
# a change number and the number of a given id stay below GIVEN_TOP (the change is refused
# alone otherwise), made numbers below NUMBER_TOP.  Ids of a table beyond it are never met by
# made ones and don't count as in use.
GIVEN_TOP = 10**15
NUMBER_TOP = 10**18


def _number_after(prefix: str, column: Column) -> Column:
    """The number after ``prefix`` in an id of that form (``NUMBER_TOP`` for longer ones), else NULL."""
    digits = F.regexp_extract(column, "^" + re.escape(prefix) + "0*([0-9]+)$", 1)
    return F.when(digits != "", F.when(F.length(digits) < len(str(NUMBER_TOP)), digits.try_cast("bigint")).otherwise(NUMBER_TOP))


def _given(existing: DataFrame, key: str, given: Column) -> Column:
    """A given id where it is truthy, in the key's type."""
    dtype = existing.schema[key].dataType
    if isinstance(dtype, T.StringType):
        return F.when(given.try_cast("string") != "", given.try_cast("string"))
    typed = given.try_cast(dtype)
    return F.when(typed != 0, typed)


def too_far(existing: DataFrame, key: str, given: Column, prefixes: Iterable[str] = ("",)) -> Column:
    """Whether a given id's number is one that ids made later could not go on from."""
    if isinstance(existing.schema[key].dataType, T.StringType):
        id_ = _given(existing, key, given)
        numbers = [_number_after(p, id_) for p in prefixes]
    else:
        numbers = [_given(existing, key, given).cast("bigint")]
    return F.coalesce(F.greatest(F.lit(0), *numbers) >= GIVEN_TOP, F.lit(False))


def new_id(existing: DataFrame, key: str, given: Column, prefix: str = "", batch: DataFrame | None = None) -> Column:
    """The given id when truthy, else one made from ``change_seq``.

    Numeric keys: ``max(key) + change_seq``.  String keys: ``prefix`` plus
    (largest number already used after that prefix + ``change_seq``).  The
    maximum, over the table and the ids given in ``batch``, is a scalar
    subquery Spark runs once; unique ``change_seq`` values then give ids that
    are unique in the batch and new to the table without any coordination
    between tasks.  A given id that collides is refused as a duplicate, as the
    database would; one that is :func:`too_far` is refused for its size and does
    not count here.
    """
    dtype = existing.schema[key].dataType
    text = isinstance(dtype, T.StringType)
    given = _given(existing, key, given)

    def number(c: Column) -> Column:
        return _number_after(prefix, c) if text else c.cast("bigint")

    used = existing.select(number(F.col(key)).alias("n")).where(F.col("n") < NUMBER_TOP)
    if batch is not None:
        used = used.unionAll(batch.select(number(given).alias("n")).where(F.col("n") < GIVEN_TOP))
    top = used.select(F.coalesce(F.max("n"), F.lit(0)).cast("bigint")).scalar()
    made = F.try_add(top, F.col(SEQ).cast("bigint"))
    made = F.when(made < NUMBER_TOP, made)
    return F.coalesce(given, F.concat(F.lit(prefix), made.cast("string")) if text else made.try_cast(dtype))


def _largest_id(existing: DataFrame, key: str, prefix: str = "") -> Column:
    """The largest id in use in the form of made ones: what a change numbered 0 would be given again."""
    if not isinstance(existing.schema[key].dataType, T.StringType):
        return existing.where(F.col(key) < NUMBER_TOP).agg(F.max(key)).scalar()
    n = _number_after(prefix, F.col(key))
    top = existing.where((n < NUMBER_TOP) & (F.col(key) == F.concat(F.lit(prefix), n.cast("string")))).agg(F.max(n)).scalar()
    return F.concat(F.lit(prefix), top.cast("string"))


# ------------------------------------------------------- generic insert


def _between(table: DataFrame, key: str, changes: DataFrame, given: Column) -> DataFrame:
    """The rows of ``table`` whose key lies between the least and the greatest given one.

    Both are scalar subqueries that Spark runs first and pushes to the Parquet
    scan, so files and row groups outside (ids ascend, and
    :mod:`innkeep.sources.keyed` stores them by range) are not read.
    """
    ids = changes.select(_given(table, key, given).alias("id"))
    low = ids.agg(F.min("id")).scalar()
    # not max(): Spark would merge the two into a struct, whose fields it doesn't push down
    high = ids.orderBy(F.desc_nulls_last("id")).limit(1).scalar()
    return table.where((F.col(key) >= low) & (F.col(key) <= high))


def append_validated(
    T_: Tables,
    table: str,
    changes: DataFrame,
    columns: dict[str, Column],
    required: Iterable[str],
    given_id: str | None = None,
    prefix: str = "",
    pre_rules: list[tuple[Column, str]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert rows after the endpoint's checks and the database's own.

    Order of checks: required fields (H16), ``pre_rules`` (the endpoint's
    extra checks, on the feed), table rules (NOT NULL, lists, ranges, sizes,
    stay order), primary key against the table, foreign keys, primary key
    within the batch (the first change wins).

    Returns ``(new_table, valid_rows, rejects)``; ``valid_rows`` keeps the
    feed in ``_in`` for jobs that derive more from the inserted rows.
    """
    spec = SPECS[table]
    base = T_[table]
    key = spec.key[0]
    cols = dict(columns)
    generated = given_id is not None
    any_given = generated and given_id in changes.columns
    if generated:
        given = _opt(changes, given_id, base.schema[key].dataType.simpleString())
        cols[key] = new_id(base, key, given, prefix, changes if any_given else None)
    df = _pack(changes, cols, required)
    rules = [(F.col("__missing"), MISSING), *(pre_rules or [])]
    rules += _spec_rules(df, spec, skip_size=[key] if generated else [])
    if any_given and not given_id.startswith("__"):
        rules.append((too_far(base, key, F.col(f"{IN}.{given_id}"), [prefix]), f"size: {key}"))
    if generated and not given_id.startswith("__"):
        own = _given(base, key, F.col(f"{IN}.{given_id}")).isNull() if any_given else F.lit(True)
        rules.append((own & (F.col("__seq") == 0) & (F.col(key) == _largest_id(base, key, prefix)), DUPLICATE))
    if any_given or not generated:
        # all other made ids are above those in use: only given ones are looked up, in the part of the table between them
        df = _present(df, _between(base, key, changes, given) if any_given else base, key, key, "__dup")
        rules.append((F.col("__dup").isNotNull(), DUPLICATE))
    df, fk = _fk_rules(df, T_, spec)
    df = _judge(df, rules + fk)
    if any_given or not generated:
        # ids made from change_seq are unique; only given ids can repeat in a batch
        df = _first_in_batch(df, [key], DUPLICATE)
    valid, rejects = _outcome(df)
    return base.unionByName(_typed(valid, base)), valid, rejects


def _update_job(
    T_: Tables, table: str, changes: DataFrame, key_field: str, columns: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Set ``columns`` of the row named by ``key_field``; the last valid change wins.

    Unknown keys change nothing and are reported as ``not found``.
    """
    spec = SPECS[table]
    base = T_[table]
    key = spec.key[0]
    df = _pack(changes, {key: F.col(key_field).try_cast(base.schema[key].dataType), **columns})
    rules = _spec_rules(df, spec)
    df = _present(df, base, key, key, "__found")
    rules.insert(0, (F.col("__found").isNull(), NOT_FOUND))
    df, fk = _fk_rules(df, T_, spec, columns)
    valid, rejects = _outcome(_judge(df, rules + fk))
    last = _latest(valid, [key], list(columns))
    return _replace(base, key, last, list(columns)), rejects


def references(parent: str, specs: dict[str, TableSpec] = SPECS) -> list[tuple[str, ForeignKey]]:
    """The foreign keys that refer to a table: ``(child, key)`` in the schema's order."""
    return [(name, fk) for name, spec in specs.items() for fk in spec.foreign_keys if fk.parent == parent]


def _reach(T_: Tables, table: str, roots: DataFrame, specs: dict[str, TableSpec], path: tuple[str, ...] = ()):
    """Walk the graph from ``roots`` (``__root``, ``__key``: rows of ``table`` that go with a deleted row).

    Yields ``(action, child, column, reached)`` for every edge met, cascades
    followed to their end; ``reached`` has the roots and the parent keys that the
    edge's column refers to.
    """
    if table in path:
        raise ValueError("cascades form a circle: " + " > ".join([*path, table]))
    for child, fk in references(table, specs):
        yield fk.on_delete, child, fk.column, roots
        if fk.on_delete == "cascade" and references(child, specs):
            key = specs[child].key[0]
            if key == fk.column:  # the child's rows are named by the parent's key
                below = roots
            else:
                rows = T_[child].select(F.col(key).alias("__child"), F.col(fk.column).alias("__of"))
                below = rows.join(roots, F.col("__of") == F.col("__key")).select("__root", F.col("__child").alias("__key"))
            yield from _reach(T_, child, below, specs, (*path, table))


def remove_rows(
    T_: Tables, table: str, changes: DataFrame, key_field: str, specs: dict[str, TableSpec] = SPECS
) -> tuple[Tables, DataFrame]:
    """Delete rows by key, with the foreign-key actions that the schema declares.

    All foreign keys that lead to the table are followed, through cascades to
    their end: a row that a restricting key refers to, itself or by a row that
    would go with it, is refused (``referenced by <child>.<column>``); else rows
    of cascading keys go, and columns of set-null keys become NULL.  A table
    added to ``specs`` is protected without more code.  Deleted once; a later
    delete of the same key finds no row.

    Per edge, the child's column is reduced to the distinct keys *of this
    batch* before it is joined, so a hot parent is one row.  Returns every table
    that an action can change, and the rejects.
    """
    base, key = T_[table], specs[table].key[0]
    df = _pack(changes, {key: F.col(key_field).try_cast(base.schema[key].dataType)})
    df = stage(_present(df, base, key, key, "__found"))
    rules = [(F.col("__found").isNull(), NOT_FOUND)]
    asked = df.where(F.col("__found")).select(F.col(key).alias("__root"), F.col(key).alias("__key")).distinct()
    edges = list(_reach(T_, table, asked, specs))
    for action, child, column, reached in edges:
        if action == "restrict":
            used = T_[child].select(F.col(column).alias("__key")).join(reached, "__key", "left_semi").distinct()
            flag = f"__ref_{child}_{column}"
            df = _present(df, reached.join(used, "__key", "left_semi").select("__root"), "__root", key, flag)
            rules.append((F.col(flag).isNotNull(), REFERENCED + f"{child}.{column}"))
    valid, rejects = _outcome(_first_in_batch(_judge(df, rules), [key], NOT_FOUND))
    gone = stage(valid.select(F.col(key).alias("__root"), F.col(key).alias("__key")).distinct())
    out = {table: _drop_keys(base, key, gone.select("__key"))}
    for action, child, column, reached in _reach(T_, table, gone, specs):
        if action != "restrict":
            ids = reached.select("__key").distinct()
            rows = out.get(child, T_[child])
            out[child] = _drop_keys(rows, column, ids) if action == "cascade" else _null_where_in(rows, column, ids)
    return out, rejects


# ------------------------------------------------------------------ I1 upsert


def upsert(table: DataFrame, changes: DataFrame, key: str | list[str], seq: str = SEQ) -> DataFrame:
    """Insert or replace by key; of several changes to one key the last wins."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in table.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in rest])
    latest = changes.groupBy(*keys).agg(F.max_by(payload, F.col(seq)).alias("__l")).select(*keys, "__l.*")
    kept = table.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(_typed(latest, table))


# -------------------------------------------------------------- I2, I3 customers


def add_customers(T_: Tables, changes: DataFrame):
    """Fname, lname, phone required; id given or generated; duplicates refused."""
    new, _, rejects = append_validated(
        T_,
        "customer",
        changes,
        {"CustomerFName": F.col("fname"), "CustomerLName": F.col("lname"), "PhoneNumber": F.col("phone")},
        required=("fname", "lname", "phone"),
        given_id="customer_id",
        prefix="CU",
    )
    return {"customer": new}, rejects


def update_customers(T_: Tables, changes: DataFrame):
    """Set first name, last name and phone by id (NULL is refused: NOT NULL)."""
    new, rejects = _update_job(
        T_,
        "customer",
        changes,
        "customer_id",
        {"CustomerFName": F.col("fname"), "CustomerLName": F.col("lname"), "PhoneNumber": F.col("phone")},
    )
    return {"customer": new}, rejects


# ------------------------------------------------------------ I7 room status


def derive_room_status(room: DataFrame, stay_changes: DataFrame, seq: str = SEQ) -> DataFrame:
    """Room status after stay inserts/updates; the last change per room wins.

    ``stay_changes`` has ``RoomID``, ``CheckOut`` and ``seq``; an optional
    ``RoomStatus`` column overrides the derived value (the booking endpoint
    sets Occupied itself).  Open stay -> Occupied, closed -> Vacant.  Rooms
    without changes keep their status.
    """
    derived = F.when(F.col("CheckOut").isNull(), "Occupied").otherwise("Vacant")
    if "RoomStatus" in stay_changes.columns:
        derived = F.coalesce(F.col("RoomStatus"), derived)
    last = stay_changes.groupBy(F.col("RoomID").alias("RoomNo")).agg(
        F.max_by(derived, F.col(seq)).alias("RoomStatus")
    )
    return _replace(room, "RoomNo", last, ["RoomStatus"])


def set_room_status(T_: Tables, changes: DataFrame):
    """I8: status must be Occupied or Vacant; the last valid change per room wins."""
    bad = ~F.coalesce(F.col("RoomStatus").isin(*ROOM_STATUSES), F.lit(False))
    room = T_["room"]
    df = _pack(changes, {"RoomNo": F.col("room_no").try_cast(room.schema["RoomNo"].dataType), "RoomStatus": F.col("status")})
    df = _present(df, room, "RoomNo", "RoomNo", "__found")
    valid, rejects = _outcome(_judge(df, [(bad, BAD_STATUS), (F.col("__found").isNull(), NOT_FOUND)]))
    last = _latest(valid, ["RoomNo"], ["RoomStatus"])
    return {"room": _replace(room, "RoomNo", last, ["RoomStatus"])}, rejects


# ------------------------------------------------------- I4, I5, I6 stays


def book_stays(T_: Tables, changes: DataFrame):
    """I4: room, customer, check-in and staff required; check-out after check-in
    when given; room, customer and front-desk staff must exist; the room is
    then Occupied (the endpoint's own update, after the trigger)."""
    res = T_["reservation"]
    id_t = res.schema["RoomID"].dataType
    new, valid, rejects = append_validated(
        T_,
        "reservation",
        changes,
        {
            "RoomID": F.col("room_id").try_cast(id_t),
            "CustomerID": F.col("customer_id").try_cast(res.schema["CustomerID"].dataType),
            "StaffID": F.col("staff_id").try_cast(res.schema["StaffID"].dataType),
            "CheckIn": F.col("check_in").try_cast(res.schema["CheckIn"].dataType),
            "CheckOut": _opt(changes, "check_out").try_cast(res.schema["CheckOut"].dataType),
        },
        required=("room_id", "customer_id", "check_in", "staff_id"),
        given_id="reservation_id",
        prefix="RES",
        # a check-out given but not readable would fail the insert
        pre_rules=[(~is_missing(F.col(f"{IN}.check_out")) & F.col("CheckOut").isNull(), INVALID_DATE)]
        if "check_out" in changes.columns
        else [],
    )
    booked = valid.select("RoomID", "CheckOut", F.lit("Occupied").alias("RoomStatus"), F.col("__seq").alias(SEQ))
    return {"reservation": new, "room": derive_room_status(T_["room"], booked)}, rejects


def stay_bill(stays: DataFrame, room: DataFrame) -> DataFrame:
    """Nights (H3) and charge (H4) of closed stays at their room's rate."""
    rates = room.select(F.col("RoomNo").alias("RoomID"), "RoomRate")
    return stays.join(rates, "RoomID", "left").select(
        "*",
        stay_nights("CheckIn", "CheckOut").alias("Nights"),
    ).withColumn("Charge", stay_charge("Nights", "RoomRate"))


def checkout_and_bill(T_: Tables, changes: DataFrame, as_of):
    """Close stays and bill them.

    ``changes``: ``change_seq, reservation_id, check_out`` (NULL -> ``as_of``).
    Unknown stays and check-outs not after check-in are refused.  Per stay
    the last valid check-out wins (each one in turn would overwrite the
    previous one and re-bill).  The room becomes Vacant; the charge (H3, H4)
    overwrites AmountPayable of every invoice of the stay, AmountPaid kept;
    a stay without an invoice gets a new one with nothing paid.

    Returns tables ``reservation``, ``room``, ``invoice``.
    """
    res, room, inv = T_["reservation"], T_["room"], T_["invoice"]
    key_t = res.schema["ReservationID"].dataType
    out_t = res.schema["CheckOut"].dataType
    df = _pack(
        changes,
        {
            "ReservationID": F.col("reservation_id").try_cast(key_t),
            # an empty check-out means "now" (as_of); one that does not parse is refused
            "CheckOut": F.when(is_missing(_opt(changes, "check_out")), F.lit(as_of).cast(out_t)).otherwise(
                _opt(changes, "check_out").try_cast(out_t)
            ),
        },
    )
    stays = res.select(
        F.col("ReservationID").alias("__rid"), "RoomID", "CustomerID", "CheckIn", F.lit(True).alias("__found")
    )
    df = df.join(stays, F.col("ReservationID") == F.col("__rid"), "left").drop("__rid")
    df = stay_bill(df, room)
    df = _judge(
        df,
        [
            (F.col("__found").isNull(), NOT_FOUND),
            (F.col("CheckOut").isNull(), INVALID_DATE),
            (F.col("CheckOut") <= F.col("CheckIn"), STAY_ORDER),
            # a bill that AmountPayable can't hold
            (F.col("Charge").isNull(), "size: AmountPayable"),
        ],
    )
    valid, rejects = _outcome(df)
    # one row per stay, read by four branches (stays, rooms, invoice update, new invoices)
    last = stage(_latest(valid, ["ReservationID"], ["RoomID", "CustomerID", "CheckIn", "CheckOut", "Charge", "__seq"]))

    new_res = _replace(res, "ReservationID", last, ["CheckOut"])
    freed = last.select("RoomID", "CheckOut", F.lit("Vacant").alias("RoomStatus"), F.col("__seq").alias(SEQ))
    new_room = derive_room_status(room, freed)

    bills = last.select("ReservationID", "CustomerID", "Charge", "__seq")
    billed = bills.select(F.col("ReservationID").alias("__bk"), F.col("Charge").alias("__charge"))
    upd = _left_spread(inv, billed, "ReservationID", "__bk")
    updated = upd.select(
        *[
            F.coalesce(F.col("__charge"), F.col(c)).cast(inv.schema[c].dataType).alias(c) if c == "AmountPayable"
            else F.col(c)
            for c in inv.columns
        ]
    )
    has_invoice = inv.where(F.col("ReservationID").isNotNull()).select("ReservationID")
    fresh = bills.join(has_invoice, "ReservationID", "left_anti")
    fresh_no = new_id(inv, "InvoiceNo", F.lit(None).cast(inv.schema["InvoiceNo"].dataType), "INV")
    created = fresh.withColumnRenamed("__seq", SEQ).select(
        fresh_no.alias("InvoiceNo"),
        "ReservationID",
        "CustomerID",
        F.col("Charge").alias("AmountPayable"),
        F.lit(0).alias("AmountPaid"),
    )
    new_inv = updated.unionByName(_typed(created, inv))
    return {"reservation": new_res, "room": new_room, "invoice": new_inv}, rejects


def delete_stays(T_: Tables, changes: DataFrame):
    """Open stays are deleted, completed ones refused; their invoices keep
    with ReservationID set NULL.  Room status is not touched."""
    res = T_["reservation"]
    df = _pack(changes, {"ReservationID": F.col("reservation_id").try_cast(res.schema["ReservationID"].dataType)})
    closed = res.select(F.col("ReservationID").alias("__rid"), F.col("CheckOut").isNotNull().alias("__closed"))
    df = df.join(closed, F.col("ReservationID") == F.col("__rid"), "left").drop("__rid")
    df = _judge(df, [(F.col("__closed").isNull(), NOT_FOUND), (F.col("__closed"), COMPLETED_DELETE)])
    # deleted once; a later delete of the same stay finds no row
    valid, rejects = _outcome(_first_in_batch(df, ["ReservationID"], NOT_FOUND))
    gone = valid.select("ReservationID").distinct()
    return {
        "reservation": _drop_keys(res, "ReservationID", gone),
        "invoice": _null_where_in(T_["invoice"], "ReservationID", gone),
    }, rejects


# ------------------------------------------------------------ I9-I11 requests


def _token_number(token: Column) -> Column:
    """The number of a token in the form of made ones (``NUMBER_TOP`` for longer ones), else NULL."""
    digits = F.regexp_extract(token, f"^{TOKEN_PREFIX}0*([0-9A-Z]+)$", 1)
    return F.when(digits != "", F.when(F.length(digits) <= 12, F.conv(digits, 36, 10).try_cast("bigint")).otherwise(NUMBER_TOP))


def submit_requests(T_: Tables, changes: DataFrame, as_of):
    """guests' booking requests.

    ``changes``: ``change_seq, fname, lname, phone, room_type, check_in,
    check_out`` and optionally ``token``.  Names and phone are trimmed and
    required, as are type and dates; check-out must be after check-in.  The
    guest is the customer with that phone (lowest id); an unseen phone
    creates a customer from its first valid request, and later requests of the
    batch with that phone reuse it.  Token: given, or the prefix + base 36 of
    (the largest number in use + ``change_seq``); a given token already used, or
    one whose number made tokens could not go on from, is refused.  Status Pending, dated
    ``as_of``.

    Returns tables ``customer`` and ``reservation_request``.
    """
    cust, req = T_["customer"], T_["reservation_request"]
    trim = {n: py_strip(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in ("fname", "lname", "phone")}
    given = F.when(_opt(changes, "token") != "", _opt(changes, "token"))
    used = req.select(_token_number(F.col("RequestToken")).alias("n")).where(F.col("n") < NUMBER_TOP)
    if "token" in changes.columns:
        used = used.unionAll(changes.select(_token_number(given).alias("n")).where(F.col("n") < GIVEN_TOP))
    # made tokens go on above the largest number in use, so no batch meets tokens of another
    top = used.select(F.coalesce(F.max("n"), F.lit(0)).cast("bigint")).scalar()
    made = F.try_add(top, F.col(SEQ).cast("bigint"))
    made = F.when(made < NUMBER_TOP, F.concat(F.lit(TOKEN_PREFIX), F.upper(F.conv(made.cast("string"), 10, 36))))
    tok = F.coalesce(given, made)
    ts = req.schema["CheckIn"].dataType
    df = _pack(
        changes,
        {
            "RequestToken": tok,
            "RoomType": F.col("room_type"),
            "CheckIn": F.col("check_in").try_cast(ts),
            "CheckOut": F.col("check_out").try_cast(ts),
            "Status": F.lit("Pending"),
            "RequestDate": F.lit(as_of).cast("date"),
            "CustomerFName": trim["fname"],
            "CustomerLName": trim["lname"],
            "PhoneNumber": trim["phone"],
        },
        required=("room_type", "check_in", "check_out"),
    )
    empty = (F.col("CustomerFName") == "") | (F.col("CustomerLName") == "") | (F.col("PhoneNumber") == "")
    # a date given but not readable: the model skips the order check and the
    # insert then fails, so the request is refused
    unreadable = (
        (~is_missing(F.col(f"{IN}.check_in")) & F.col("CheckIn").isNull())
        | (~is_missing(F.col(f"{IN}.check_out")) & F.col("CheckOut").isNull())
    )
    rules = [
        (F.col("__missing") | empty, MISSING),
        (unreadable, INVALID_DATE),
        (F.col("CheckOut") <= F.col("CheckIn"), REQUEST_ORDER),
    ]
    rules += _spec_rules(df, SPECS["reservation_request"], skip_size=["RequestToken"])
    rules += [r for r in _spec_rules(df, SPECS["customer"]) if "CustomerID" not in r[1]]
    number = _token_number(F.col("RequestToken"))
    made_form = F.concat(F.lit(TOKEN_PREFIX), F.upper(F.conv(number.cast("string"), 10, 36)))
    largest = req.where((number < NUMBER_TOP) & (F.col("RequestToken") == made_form)).agg(F.max(F.struct(number.alias("n"), F.col("RequestToken").alias("t"))).alias("m")).select("m.t").scalar()
    rules.append(((F.col("__seq") == 0) & (F.col("RequestToken") == largest), DUPLICATE))
    if "token" in changes.columns:
        rules.append((F.coalesce(_token_number(F.col(f"{IN}.token")) >= GIVEN_TOP, F.lit(False)), "size: RequestToken"))
        df = _present(df, _between(req, "RequestToken", changes, given), "RequestToken", "RequestToken", "__dup")
        rules.append((F.col("__dup").isNotNull(), DUPLICATE))
    df = _judge(df, rules)
    if "token" in changes.columns:
        # tokens made from change_seq are unique; only given tokens can repeat
        df = _first_in_batch(df, ["RequestToken"], DUPLICATE)
    valid, rejects = _outcome(df)

    # guest by phone: existing customers (lowest id) for the phones of the batch, else one made from the first request
    phones = valid.groupBy("PhoneNumber").agg(F.min("__seq").alias(SEQ))
    known = (
        cust.join(phones, "PhoneNumber", "left_semi")
        .groupBy("PhoneNumber")
        .agg(F.min("CustomerID").alias("__known"))
    )
    made_id = new_id(cust, "CustomerID", F.lit(None).cast(cust.schema["CustomerID"].dataType), "CU")
    # staged, as are the rows: a task then sorts for one or two joins at a time, and no branch makes them again
    guests = stage(
        phones.join(known, "PhoneNumber", "left").select(
            "PhoneNumber",
            F.coalesce("__known", made_id).alias("CustomerID"),
            F.when(F.col("__known").isNull(), F.col(SEQ)).alias("__maker"),
        )
    )
    rows = stage(
        valid.drop(IN).join(guests, "PhoneNumber", "left")
        .withColumn("RoomNo", F.lit(None).cast(req.schema["RoomNo"].dataType))
        .withColumn("StaffID", F.lit(None).cast(req.schema["StaffID"].dataType))
    )
    new_customers = _typed(rows.where(F.col("__seq") == F.col("__maker")), cust)
    return {
        "customer": cust.unionByName(new_customers),
        "reservation_request": req.unionByName(_typed(rows, req)),
    }, rejects


def decide_requests(T_: Tables, approvals: DataFrame | None = None, declines: DataFrame | None = None):
    """I10 + I11: approve or decline Pending requests.

    ``approvals``: ``change_seq, token, room_no, staff_id``;
    ``declines``: ``change_seq, token, staff_id``.  Staff is required (the
    model's fixed fallback id is not carried over), a room too for an
    approval.  The request must exist and be Pending.  An approval inserts a
    stay with the request's dates (room and front-desk staff must exist,
    check-out after check-in) and the trigger then sets the room Vacant, the
    stay having a check-out.  Of several valid decisions on one token the
    first (by ``change_seq``, both kinds together) wins; later ones are
    refused as "already approved/declined".

    Returns tables ``reservation``, ``reservation_request``, ``room``.
    """
    req, res = T_["reservation_request"], T_["reservation"]
    parts = []
    for kind, feed in (("approve", approvals), ("decline", declines)):
        if feed is None:
            continue
        parts.append(
            feed.select(
                F.lit(kind).alias("kind"),
                F.col(SEQ),
                F.col("token").try_cast("string").alias("token"),
                _opt(feed, "room_no").cast("string").alias("room_no"),
                F.col("staff_id").try_cast("string").alias("staff_id"),
            )
        )
    if not parts:
        raise ValueError("decide_requests needs approvals, declines or both")
    feed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    id_t = res.schema["RoomID"].dataType
    df = _pack(
        feed,
        {
            "RequestToken": F.col("token"),
            "kind": F.col("kind"),
            "RoomID": F.when(F.col("kind") == "approve", F.col("room_no").try_cast(id_t)),
            "StaffID": F.col("staff_id").try_cast(res.schema["StaffID"].dataType),
            "room_missing": (F.col("kind") == "approve") & is_missing(F.col("room_no")),
            "staff_missing": is_missing(F.col("staff_id")),
        },
    )
    current = req.select(
        F.col("RequestToken").alias("__tk"),
        F.col("Status").alias("__status"),
        "CustomerID",
        "CheckIn",
        "CheckOut",
    )
    df = df.join(current, F.col("RequestToken") == F.col("__tk"), "left").drop("__tk")
    approve = F.col("kind") == "approve"
    df = _present(df, T_["room"], "RoomNo", "RoomID", "__room_ok")
    df = _present(df, T_["frontdesk"], "StaffID", "StaffID", "__staff_ok")
    rules = [
        (F.col("room_missing"), "room_no is required"),
        (F.col("staff_missing"), "staff_id is required"),
        (F.col("__status").isNull(), NOT_FOUND),
        (F.col("__status") != "Pending", F.concat(F.lit(ALREADY), F.lower("__status"), F.lit("."))),
    ]
    # checks the database makes when the change is written (after the status check)
    write_rules = [
        (approve & F.col("__room_ok").isNull(), "foreign_key: RoomID"),
        (F.col("__staff_ok").isNull(), "foreign_key: StaffID"),
        (approve & (F.col("CheckOut") <= F.col("CheckIn")), STAY_ORDER),
    ]

    def first_of(pairs):
        return F.coalesce(*[F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in pairs])

    df = df.withColumn("__pre", first_of(rules)).withColumn("__post", first_of(write_rules))
    # the winner per token: the first change that passes every check
    winner = (
        df.where(F.col("__pre").isNull() & F.col("__post").isNull())
        .groupBy("RequestToken")
        .agg(F.min_by("kind", "__seq").alias("__wkind"), F.min("__seq").alias("__first"))
    )
    df = df.join(winner, "RequestToken", "left")
    done = F.when(F.col("__wkind") == "approve", "approved").otherwise("declined")
    # a change after the winner finds the request decided, whatever else is wrong with it
    after = F.col("__first").isNotNull() & (F.col("__seq") > F.col("__first"))
    df = df.withColumn(
        "reason",
        F.coalesce(
            F.col("__pre"),
            F.when(after, F.concat(F.lit(ALREADY), done, F.lit("."))),
            F.col("__post"),
        ),
    )
    valid, rejects = _outcome(df)

    ok_appr = valid.where(F.col("kind") == "approve")
    stays = ok_appr.select(
        F.col("__seq").alias(SEQ),
        "RoomID",
        "CustomerID",
        "StaffID",
        "CheckIn",
        "CheckOut",
    ).withColumn("ReservationID", new_id(res, "ReservationID", F.lit(None).cast(res.schema["ReservationID"].dataType), "RES"))
    new_res = res.unionByName(_typed(stays, res))
    new_room = derive_room_status(T_["room"], stays.select("RoomID", "CheckOut", SEQ))
    updates = valid.select(
        "RequestToken",
        F.when(F.col("kind") == "approve", "Approved").otherwise("Declined").alias("Status"),
        F.when(F.col("kind") == "approve", F.col("RoomID")).alias("RoomNo"),
        "StaffID",
    )
    new_req = _replace(req, "RequestToken", updates, ["Status", "RoomNo", "StaffID"])
    return {"reservation": new_res, "reservation_request": new_req, "room": new_room}, rejects


def approve_requests(T_: Tables, changes: DataFrame):
    """I10 on its own."""
    return decide_requests(T_, approvals=changes)


def decline_requests(T_: Tables, changes: DataFrame):
    """I11 on its own."""
    return decide_requests(T_, declines=changes)


# ------------------------------------------------------------ I12, I13 invoices


def record_payments(T_: Tables, changes: DataFrame):
    """Add positive payments to AmountPaid (no upper limit).

    ``changes``: ``change_seq, invoice_no, amount``.  Valid payments are summed
    per invoice (partial aggregation) and added once.  If the new total does
    not fit DECIMAL(10,2), all of that invoice's payments in the batch are
    refused.
    """
    inv = T_["invoice"]
    money = inv.schema["AmountPaid"].dataType
    df = _pack(
        changes,
        {"InvoiceNo": F.col("invoice_no").try_cast(inv.schema["InvoiceNo"].dataType), "amount": F.col("amount").try_cast("decimal(20,2)")},
    )
    df = _present(df, inv, "InvoiceNo", "InvoiceNo", "__found")
    df = stage(
        _judge(
            df,
            [
                (F.col("amount").isNull() | (F.col("amount") <= 0), BAD_PAYMENT),
                (F.col("__found").isNull(), NOT_FOUND),
            ],
        )
    )
    ok = df.where(F.col("reason").isNull())
    totals = ok.groupBy("InvoiceNo").agg(F.sum("amount").alias("__paid_now"))
    paid = inv.select(F.col("InvoiceNo").alias("__ik"), F.col("AmountPaid").alias("__before"))
    fits = totals.join(paid, F.col("InvoiceNo") == F.col("__ik")).select(
        "InvoiceNo",
        (F.col("__before") + F.col("__paid_now")).alias("AmountPaid"),
        (F.abs(F.col("__before") + F.col("__paid_now")) < 10 ** (money.precision - money.scale)).alias("__fits"),
    )
    # only the invoices over the limit go back to the payments (none, as a rule); their
    # side is a plain shuffle of its own, so a hot invoice's payments can be split
    over = fits.where(~F.col("__fits")).select(F.col("InvoiceNo").alias("__over"))
    df = df.join(over, F.col("InvoiceNo") == F.col("__over"), "left")
    df = _judge(df, [(F.col("__over").isNotNull(), "size: AmountPaid")]).drop("__over")
    _, rejects = _outcome(df, staged=True)
    return {"invoice": _replace(inv, "InvoiceNo", fits.where("__fits"), ["AmountPaid"])}, rejects


def set_amount_paid(T_: Tables, changes: DataFrame):
    """I12 (the endpoint itself): set AmountPaid by invoice; only a missing
    amount is refused (0 is allowed).  The last change per invoice wins."""
    inv = T_["invoice"]
    new, rejects = _update_job(
        T_, "invoice", changes, "invoice_no",
        {"AmountPaid": F.col("amount_paid").try_cast(inv.schema["AmountPaid"].dataType)},
    )
    return {"invoice": new}, rejects


def create_invoices(T_: Tables, changes: DataFrame):
    """Customer and payable required (0 allowed); paid defaults to 0;
    a reservation is optional but must exist when given."""
    inv = T_["invoice"]
    payable_missing = F.col(f"{IN}.amount_payable").isNull()
    new, _, rejects = append_validated(
        T_,
        "invoice",
        changes,
        {
            "ReservationID": _truthy_or_null(changes, "reservation_id").try_cast(inv.schema["ReservationID"].dataType),
            "CustomerID": F.col("customer_id").try_cast(inv.schema["CustomerID"].dataType),
            "AmountPayable": F.col("amount_payable").try_cast(inv.schema["AmountPayable"].dataType),
            "AmountPaid": F.coalesce(
                F.when(_opt(changes, "amount_paid", "double").try_cast("double") != 0, _opt(changes, "amount_paid", "double")),
                F.lit(0),
            ).cast(inv.schema["AmountPaid"].dataType),
        },
        required=("customer_id",),
        given_id="invoice_no",
        prefix="INV",
        pre_rules=[(payable_missing, MISSING)],
    )
    return {"invoice": new}, rejects


# ---------------------------------------------------------- I14, I15 staff


def onboard_staff(T_: Tables, changes: DataFrame):
    """A staff row plus its subtype row.

    ``changes``: ``change_seq, fname, lname, role, shift`` and optionally
    ``staff_id``, ``floor`` (default 0) and ``full_name`` (registration: split
    into first name and rest, H12, when ``fname`` is not given).  Housekeeping
    goes to HOUSEKEEPING with its floor, any other role to FRONTDESK.

    Returns tables ``staff``, ``housekeeping``, ``frontdesk``.
    """
    staff = T_["staff"]
    full = _opt(changes, "full_name")
    first, rest = split_name(full)
    use_full = _opt(changes, "fname").isNull() & full.isNotNull()
    fname = F.when(use_full, first).otherwise(_opt(changes, "fname"))
    lname = F.when(use_full, rest).otherwise(_opt(changes, "lname"))
    role = F.col("role")
    hk = role == "Housekeeping"
    given = _opt(changes, "staff_id")
    key_t = staff.schema["StaffID"].dataType.simpleString()
    own = changes if "staff_id" in changes.columns else None
    staff_id = F.when(hk, new_id(staff, "StaffID", given, "HK", own)).otherwise(new_id(staff, "StaffID", given, "FD", own))
    feed = (
        changes.withColumn("__fname", fname)
        .withColumn("__lname", lname)
        .withColumn("__via_full", use_full)
        .withColumn("__staff_id", staff_id.try_cast(key_t))
    )
    floor = F.coalesce(F.when(_opt(changes, "floor", "int") != 0, _opt(changes, "floor", "int")), F.lit(0))
    lname_missing = ~F.col(f"{IN}.__via_full") & is_missing(F.col(f"{IN}.__lname"))
    new_staff, valid, rejects = append_validated(
        T_,
        "staff",
        feed,
        {
            "StaffFName": F.col("__fname"),
            "StaffLName": F.col("__lname"),
            "StaffRole": role,
            "Shift": F.col("shift"),
            "AssignedFloor": F.when(hk, floor.cast("int")),
        },
        required=("__fname", "role", "shift"),
        given_id="__staff_id",
        pre_rules=[
            (lname_missing, MISSING),
            (too_far(staff, "StaffID", F.col(f"{IN}.staff_id") if "staff_id" in changes.columns else F.lit(None).cast(key_t), ("HK", "FD")), "size: StaffID"),
            (~F.coalesce(F.col("Shift").isin(*SPECS["frontdesk"].col("Shift").values), F.lit(False)), "enum: Shift"),
            (F.col("AssignedFloor").isNotNull() & ~F.col("AssignedFloor").between(0, 20), "range: AssignedFloor"),
        ],
    )
    rejects = rejects.drop("__fname", "__lname", "__via_full", "__staff_id")
    housekeeping = valid.where(F.col("StaffRole") == "Housekeeping").select("StaffID", "Shift", "AssignedFloor")
    frontdesk = valid.where(F.col("StaffRole") != "Housekeeping").select("StaffID", "Shift")
    return {
        "staff": new_staff,
        "housekeeping": T_["housekeeping"].unionByName(_typed(housekeeping, T_["housekeeping"])),
        "frontdesk": T_["frontdesk"].unionByName(_typed(frontdesk, T_["frontdesk"])),
    }, rejects


def remove_staff(T_: Tables, changes: DataFrame):
    """Delete staff; refused while stays name them (restrict).

    Cascades the subtype rows; rooms' housekeeper and requests' staff become
    NULL (set null).  Returns tables ``staff``, ``housekeeping``,
    ``frontdesk``, ``room``, ``reservation_request``.
    """
    return remove_rows(T_, "staff", changes, "staff_id")


# ----------------------------------------------------------- I16 customers


def remove_customers(T_: Tables, changes: DataFrame):
    """I16: delete customers; refused while stays, events, invoices or orders
    refer to them; their feedback and requests are deleted with them."""
    return remove_rows(T_, "customer", changes, "customer_id")


# ------------------------------------------------------------- I17, I18 rooms


def add_rooms(T_: Tables, changes: DataFrame):
    """I17 (add): type and rate required (a zero rate counts as missing);
    status Vacant; housekeeper optional but must exist."""
    room = T_["room"]
    new, _, rejects = append_validated(
        T_,
        "room",
        changes,
        {
            "RoomType": F.col("room_type"),
            "RoomRate": F.col("rate").try_cast(room.schema["RoomRate"].dataType),
            "RoomStatus": F.lit("Vacant"),
            "HousekeeperID": _truthy_or_null(changes, "housekeeper_id").try_cast(room.schema["HousekeeperID"].dataType),
        },
        required=("room_type", "rate"),
        given_id="room_no",
        prefix="R",
    )
    return {"room": new}, rejects


def update_rooms(T_: Tables, changes: DataFrame):
    """I17 (update): set type and rate by room number; NULLs are refused."""
    room = T_["room"]
    new, rejects = _update_job(
        T_,
        "room",
        changes,
        "room_no",
        {"RoomType": F.col("room_type"), "RoomRate": F.col("rate").try_cast(room.schema["RoomRate"].dataType)},
    )
    return {"room": new}, rejects


def block_room_deletes(changes: DataFrame) -> DataFrame:
    """Every room delete is refused (the trigger)."""
    return changes.withColumn("reason", F.lit(ROOM_DELETE))


# -------------------------------------------------------- I19 simple inserts


def add_events(T_: Tables, changes: DataFrame):
    """Type, date, duration, host and hall required; host and hall must exist."""
    ev = T_["event"]
    new, _, rejects = append_validated(
        T_,
        "event",
        changes,
        {
            "EventType": F.col("event_type"),
            "EventDate": F.col("event_date").try_cast("date"),
            "EventDuration": F.col("duration").try_cast(ev.schema["EventDuration"].dataType),
            "Host": F.col("host_id").try_cast(ev.schema["Host"].dataType),
            "HallID": F.col("hall_id").try_cast(ev.schema["HallID"].dataType),
        },
        required=("event_type", "event_date", "duration", "host_id", "hall_id"),
        given_id="event_id",
        prefix="EV",
    )
    return {"event": new}, rejects


def add_halls(T_: Tables, changes: DataFrame):
    """Name and capacity required."""
    new, _, rejects = append_validated(
        T_,
        "conference_hall",
        changes,
        {"HallName": F.col("name"), "Capacity": F.col("capacity").try_cast("int")},
        required=("name", "capacity"),
        given_id="hall_id",
        prefix="CH",
    )
    return {"conference_hall": new}, rejects


def add_restaurants(T_: Tables, changes: DataFrame):
    """Name and seating capacity required."""
    new, _, rejects = append_validated(
        T_,
        "restaurant",
        changes,
        {"RestaurantName": F.col("name"), "SeatingCapacity": F.col("seating_capacity").try_cast("int")},
        required=("name", "seating_capacity"),
        given_id="restaurant_id",
        prefix="RT",
    )
    return {"restaurant": new}, rejects


def add_orders(T_: Tables, changes: DataFrame):
    """Customer, restaurant and details required; invoice optional."""
    ro = T_["restaurant_order"]
    new, _, rejects = append_validated(
        T_,
        "restaurant_order",
        changes,
        {
            "CustomerID": F.col("customer_id").try_cast(ro.schema["CustomerID"].dataType),
            "RestaurantID": F.col("restaurant_id").try_cast(ro.schema["RestaurantID"].dataType),
            "InvoiceID": _truthy_or_null(changes, "invoice_id").try_cast(ro.schema["InvoiceID"].dataType),
            "OrderDetails": F.col("order_details"),
        },
        required=("customer_id", "restaurant_id", "order_details"),
        given_id="order_id",
        prefix="RO",
    )
    return {"restaurant_order": new}, rejects


def add_feedback(T_: Tables, changes: DataFrame, as_of):
    """Customer, rating and comments required; rating an integer 1..5
    (text is parsed; a fraction is truncated, as ``int()`` does); dated
    ``as_of``."""
    fb = T_["customer_feedback"]
    raw = F.col("rating")
    if isinstance(changes.schema["rating"].dataType, T.StringType):
        as_int = F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("bigint"))
    else:
        as_int = raw.try_cast("double").try_cast("bigint")
    as_int = F.when(as_int.between(1, 5), as_int.cast("int"))  # anything else is refused below
    new, _, rejects = append_validated(
        T_,
        "customer_feedback",
        changes,
        {
            "CustomerID": F.col("customer_id").try_cast(fb.schema["CustomerID"].dataType),
            "Rating": as_int,
            "Comments": F.col("comments"),
            "FeedbackDate": F.lit(as_of).cast("date"),
        },
        required=("customer_id", "rating", "comments"),
        given_id="feedback_id",
        prefix="FB",
        pre_rules=[(F.col("Rating").isNull() | ~F.col("Rating").between(1, 5), BAD_RATING)],
    )
    return {"customer_feedback": new}, rejects


def remove_feedback(T_: Tables, changes: DataFrame):
    """Delete feedback by id."""
    return remove_rows(T_, "customer_feedback", changes, "feedback_id")


__all__ = [
    "upsert", "add_customers", "update_customers", "book_stays", "checkout_and_bill", "delete_stays",
    "derive_room_status", "set_room_status", "submit_requests", "decide_requests", "approve_requests",
    "decline_requests", "record_payments", "set_amount_paid", "create_invoices", "onboard_staff", "remove_staff",
    "remove_customers", "remove_rows", "references", "add_rooms", "update_rooms", "block_room_deletes", "add_events", "add_halls",
    "add_restaurants", "add_orders", "add_feedback", "remove_feedback", "new_id", "append_validated",
    "stay_bill", "FEEDS",
]
