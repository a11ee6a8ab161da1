"""Python values as SQL literals, for long conditions sent to the parser in one piece."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 1 << 31 else str(value)
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")
