"""Canonical JSON and its SHA-256, on the driver for documents; rows are hashed as columns."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import UTC, date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted(_plain(v) for v in x)
    if isinstance(x, Decimal):
        return format(x, "f")
    if isinstance(x, datetime):
        if x.tzinfo is None:
            raise ValueError("a time without zone")
        return x.astimezone(UTC).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("not a finite number")
    return x


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; decimals as text, times in UTC, no infinities."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def strict_loads(text: str):
    """JSON in which a key stands once and every number is finite."""

    def once(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("a key stands twice")
        return found

    def never(name):
        raise ValueError(f"not a finite number: {name}")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def row_sha256(*columns: str) -> Column:
    """Hash of the columns' texts with a separator that no number holds."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def checksum_of(text: Column) -> Column:
    """The 64 hex digits that a checksum line starts with, else null."""
    found = F.regexp_extract(text, r"^\s*([0-9a-fA-F]{64})(?:\s|$)", 1)
    return F.when(found != "", F.lower(found))
