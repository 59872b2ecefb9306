"""Catalog reads and mutations.

A catalog holds one row per key. ``key`` is ``("id",)`` for the catalog of one node and
``("node_id", "id")`` for the catalogs of a fleet in one table. Mutations never change a
table in place: each takes the current catalog and gives the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.operators.running import row_index
from steward.schemas import CATALOG_COLUMNS, LOCAL, REMOTE

Key = Sequence[str]

# Up to this many leading rows a page is read with offset and limit; deeper pages are
# cut out of a distributed row index, so that no task holds everything before the page.
SHALLOW_ROWS = 100_000


class Updated(NamedTuple):
    catalog: DataFrame
    old: DataFrame
    missing: DataFrame


class Removed(NamedTuple):
    catalog: DataFrame
    removed: DataFrame
    missing: DataFrame


def timestamp(moment: str | Column) -> Column:
    return F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment


def _of_keys(catalog: DataFrame, keys: DataFrame, key: Key) -> DataFrame:
    """The catalog's rows for some keys.

    An outer or anti join from the keys would shuffle the whole catalog, however few they
    are; a semi join can broadcast them and leaves only what they need to be joined to.
    """
    return catalog.join(keys.select(*key), list(key), "left_semi")


def lookup(catalog: DataFrame, ids: DataFrame, key: Key = ("id",)) -> DataFrame:
    """Each asked-for key with its row, and ``found`` false where there is none."""
    key = list(key)
    rows = _of_keys(catalog, ids, key).withColumn("found", F.lit(True))
    return (
        ids.select(*key)
        .join(rows, key, "left")
        .select(*CATALOG_COLUMNS, F.coalesce("found", F.lit(False)).alias("found"))
    )


def by_status(catalog: DataFrame, status: str) -> DataFrame:
    return catalog.filter(F.col("status") == status)


def older_than(catalog: DataFrame, moment: str | Column) -> DataFrame:
    """Rows last written strictly before ``moment``."""
    return catalog.filter(F.col("modified") < timestamp(moment))


def valid_status(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("status").isin(REMOTE, LOCAL))


def page(
    df: DataFrame,
    limit: int,
    number: int,
    order: Sequence[str] = (),
    shallow_rows: int = SHALLOW_ROWS,
) -> DataFrame:
    """Page ``number`` (from zero) of ``limit`` rows.

    The catalog's key follows any order given, so that rows of one id on several nodes fall
    in the same order on either side of ``shallow_rows``.
    """
    order = list(dict.fromkeys([*order, *(c for c in ("id", "node_id") if c in df.columns)]))
    first = limit * number
    if first + limit <= shallow_rows:
        return df.orderBy(*order).offset(first).limit(limit)
    rows = row_index(df, order, name="_row")
    inside = (F.col("_row") > first) & (F.col("_row") <= first + limit)
    return rows.filter(inside).drop("_row")


def latest(rows: DataFrame, key: Key, seq: Column | str) -> DataFrame:
    """The last row per key. It combines before the shuffle, so a repeated key stays cheap."""
    others = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*others), seq).alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in others])
    )


def keep_state(rows: DataFrame, catalog: DataFrame, key: Key) -> DataFrame:
    """The rows, with size, status and replications of those the catalog knows."""
    kept = ["size", "status", "replications"]
    known = _of_keys(catalog, rows, key).select(*key, *[F.col(c).alias(f"_{c}") for c in kept])
    return rows.join(known, list(key), "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in CATALOG_COLUMNS]
    )


def upsert(
    catalog: DataFrame,
    rows: DataFrame,
    as_of: str | Column,
    key: Key = ("id",),
    seq: Column | str | None = None,
    preserve: bool = False,
) -> DataFrame:
    """Insert the rows, or overwrite every column of those already there.

    ``seq`` orders rows with one key, the last of which counts; leave it out when the
    rows are unique. ``preserve`` keeps size, status and replications of known rows.
    """
    key = list(key)
    if seq is not None:
        rows = latest(rows, key, seq)
    rows = rows.withColumn("modified", timestamp(as_of))
    if preserve:
        rows = keep_state(rows, catalog, key)
    untouched = catalog.join(rows.select(*key), key, "left_anti")
    return untouched.select(*CATALOG_COLUMNS).unionByName(rows.select(*CATALOG_COLUMNS))


def update_existing(
    catalog: DataFrame, rows: DataFrame, as_of: str | Column, key: Key = ("id",)
) -> Updated:
    """Overwrite the rows that are there; give their old form, and the rows that are not.

    ``rows`` holds one row per key and any of the other catalog columns.
    """
    key = list(key)
    changed = [c for c in CATALOG_COLUMNS if c in rows.columns and c not in (*key, "modified")]
    new = rows.select(*key, F.struct(*changed).alias("_new"))
    hit = F.col("_new").isNotNull()
    values = {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in changed}
    values["modified"] = F.when(hit, timestamp(as_of)).otherwise(F.col("modified"))
    following = catalog.join(new, key, "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in CATALOG_COLUMNS]
    )
    old = _of_keys(catalog, rows, key).select(*CATALOG_COLUMNS)
    return Updated(following, old, rows.join(old.select(*key), key, "left_anti"))


def remove(catalog: DataFrame, ids: DataFrame, key: Key = ("id",)) -> Removed:
    """Delete by key; give the deleted rows, and the keys that were not there."""
    key = list(key)
    keys = ids.select(*key)
    removed = _of_keys(catalog, ids, key).select(*CATALOG_COLUMNS)
    return Removed(
        catalog.join(keys, key, "left_anti").select(*CATALOG_COLUMNS),
        removed,
        keys.distinct().join(removed.select(*key), key, "left_anti"),
    )
