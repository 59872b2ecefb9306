"""Folding an ordered feed of ``+`` and ``-`` lines into the net change per id.

Per id the state is none, add or remove. A ``+`` line moves it one step up and a ``-``
line one step down, and it stays where it is at the ends, so order counts and no sum
will do. But any run of lines is a map from the state before it to the state after it,
and such maps compose. So the feed is folded in chunks of bounded length. The maps of an id are
numbered in order without gaps, and neighbours are composed, level by level, until one is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.operators.running import running
from steward.schemas import ADD, REMOVE
from steward.session import settle

# A chunk spans this many order values, hence at most this many lines of one id; and so many
# maps are composed at once.
CHUNK = 1 << 18

NONE = "none"

# One walker per state a run of lines may start in: where it ends, and the name it carries,
# null as long as that is still the name it came with. Kept flat, as a struct per step is
# what a fold costs.
_STARTS = {"zero": 0, "up": 1, "down": -1}


def _state(walkers: dict[str, tuple[Column, Column]]) -> Column:
    return F.struct(
        *[
            part
            for start, (at, name) in walkers.items()
            for part in (at.alias(f"{start}_at"), name.alias(f"{start}_name"))
        ]
    )


def _fold(items: Column, advance) -> Column:
    blank = F.lit(None).cast("string")
    begin = _state({start: (F.lit(at), blank) for start, at in _STARTS.items()})

    def merge(state: Column, item: Column) -> Column:
        return _state(
            {s: advance(state[f"{s}_at"], state[f"{s}_name"], item) for s in _STARTS}
        )

    return F.aggregate(items, begin, merge)


def _step(at: Column, name: Column, line: Column) -> tuple[Column, Column]:
    """One line: a step, held within -1 and 1; a step away from zero takes the line's name."""
    moved = F.greatest(F.lit(-1), F.least(F.lit(1), at + line["move"]))
    return moved, F.when(at == 0, line["name"]).when(at == line["move"], name)


def _through(at: Column, name: Column, item: Column) -> tuple[Column, Column]:
    """A whole chunk: enter by the state at hand; a null name means the name at hand."""
    chunk = item["_map"]

    def taken(part: str) -> Column:
        return (
            F.when(at == 0, chunk[f"zero_{part}"])
            .when(at == 1, chunk[f"up_{part}"])
            .otherwise(chunk[f"down_{part}"])
        )

    return taken("at"), F.when(taken("at") != 0, F.coalesce(taken("name"), name))


def _ordered(columns: Sequence[str], *payload: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns, *payload)))


def _composed(maps: DataFrame, group: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    return maps.groupBy(*group).agg(_fold(_ordered(order, "_map"), _through).alias("_map"))


def fold_changes(
    changes: DataFrame,
    order: Sequence[str] = ("seq",),
    key: Sequence[str] = ("id",),
    chunk: int = CHUNK,
    keep_none: bool = False,
) -> DataFrame:
    """Net change per key from rows with ``op`` (add or remove), ``name`` and a unique order.

    The last order column is a whole number. No group holds more than ``chunk`` rows, however many
    lines, files and blocks a key has.
    """
    key, prefix, last = list(key), list(order[:-1]), order[-1]
    move = F.when(F.col("op") == ADD, 1).when(F.col("op") == REMOVE, -1)
    rows = changes.filter(F.col("op").isin(ADD, REMOVE)).select(
        *key, *prefix, last, move.alias("move"), "name"
    )
    maps = settle(
        rows.groupBy(*key, *prefix, F.expr(f"`{last}` div {chunk}").alias("_at"))
        .agg(_ordered([last], "move", "name").alias("_lines"))
        .select(*key, *prefix, "_at", _fold(F.col("_lines"), _step).alias("_map"))
    )
    place = [*prefix, "_at"]
    most = maps.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if most > chunk:
        maps, place = running(maps, key, place, rank="_n"), ["_n"]
    while most > chunk:
        above = F.expr(f"(_n + {chunk - 1}) div {chunk}").alias("_up")
        maps = _composed(maps, [*key, above], place).withColumnRenamed("_up", "_n")
        most = -(-most // chunk)
    done = _composed(maps, key, place).withColumnRenamed("_map", "_end")
    at = F.col("_end")["zero_at"]
    change = F.when(at == 1, ADD).when(at == -1, REMOVE).otherwise(NONE)
    net = done.select(*key, F.col("_end")["zero_name"].alias("name"), change.alias("change"))
    return net if keep_none else net.filter(F.col("change") != NONE)
