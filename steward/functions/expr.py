"""Column expressions. All are built-ins, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from steward.functions.cid import decoded
from steward.schemas import ADD, REMOVE

# The two textual forms of a content id. This is a syntax check, not a
# decoder: it lets some strings through that a decoder would refuse.
ID_PATTERN = "^(Qm[1-9A-HJ-NP-Za-km-z]{44}|b[a-z2-7]{58,})$"

# In place of a pattern: the id is decoded, in any of its bases.
ID_DECODED = "decoded"

# Byte units, decimal and binary, in lower case.
BYTE_UNITS = {
    "": 1,
    "b": 1,
    "k": 10**3, "kb": 10**3, "ki": 2**10, "kib": 2**10,
    "m": 10**6, "mb": 10**6, "mi": 2**20, "mib": 2**20,
    "g": 10**9, "gb": 10**9, "gi": 2**30, "gib": 2**30,
    "t": 10**12, "tb": 10**12, "ti": 2**40, "tib": 2**40,
    "p": 10**15, "pb": 10**15, "pi": 2**50, "pib": 2**50,
    "e": 10**18, "eb": 10**18, "ei": 2**60, "eib": 2**60,
}

DRAW_RANGE = 1 << 24


def field(line: Column, n: int) -> Column:
    """Field ``n`` of a line, from zero, between runs of Unicode white space; else empty.

    The pattern stops at the field, so the rest of a long line costs nothing.
    """
    return F.regexp_extract(line, rf"(?U)^\s*(?:\S+\s+){{{n}}}(\S+)", 1)


def has_suffix(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def strip_op(field: Column) -> Column:
    """Drop one leading ``+`` and then one leading ``-``."""
    return F.regexp_replace(field, r"^\+?-?", "")


def valid_id(column: Column, pattern: str = ID_PATTERN) -> Column:
    """Whether an id fits a pattern or, with ``ID_DECODED``, is a content id that can be decoded; a null then is none."""
    return decoded(column).isNotNull() if pattern == ID_DECODED else column.rlike(pattern)


def change_of(line: Column) -> Column:
    """``add`` or ``remove`` from the first character of a diff line, else null."""
    return F.when(line.startswith("+"), ADD).when(line.startswith("-"), REMOVE)


def activation_energy(replications: Column, threshold: Column) -> Column:
    """``replications / threshold`` in single precision."""
    return (replications.cast("float") / threshold.cast("float")).cast("float")


def draw(seed: int, run: int, node_id: Column, id_: Column) -> Column:
    """A repeatable uniform number in [0, 1) per seed, run, node and file.

    It has 24 bits, so single precision holds it exactly.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(run)), node_id, id_))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") / F.lit(DRAW_RANGE)


def parse_bytes(text: Column) -> Column:
    """Bytes in a size such as ``50GB`` or ``1,024 MiB``; null when it is not one."""
    number = F.regexp_replace(F.regexp_extract(text, r"^([0-9.,]+)", 1), ",", "")
    unit = F.lower(F.regexp_extract(text, r"(?sU)^[0-9.,]+\s*(.*?)\s*$", 1))
    factors = ", ".join(f"'{name}', {size}L" for name, size in BYTE_UNITS.items())
    factor = F.try_element_at(F.expr(f"map({factors})"), unit)
    value = number.try_cast("double") * factor.cast("double")
    return F.when(value < F.lit(float(2**63)), value.cast("bigint"))


def effective_limit(limit: Column, disk_free: Column, initialised: Column) -> Column:
    """Before the first start a node offers no more than the free space of its disk."""
    return F.when(~initialised & (limit > disk_free), disk_free).otherwise(limit)
