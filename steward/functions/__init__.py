"""Column expressions shared by the jobs."""

from steward.functions.expr import (  # noqa: F401
    ID_DECODED,
    ID_PATTERN,
    activation_energy,
    change_of,
    draw,
    effective_limit,
    field,
    has_suffix,
    parse_bytes,
    strip_op,
    valid_id,
)
