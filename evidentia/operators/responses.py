"""What is answered of an evidence record: its columns without those that only the store needs, lists and maps as JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TABLES

#: Columns that are not answered: where a record came from, but for addresses, whose answers name their scan.
HIDDEN = {name: {"scan_id"} for name in TABLES} | {"bag_validation": set(), "scans": {"user_id"}, "shops": set(), "status_check": set()}


def answered_columns(name: str) -> list[str]:
    """The columns of a table that are answered, in its order."""
    columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", TABLES[name])]
    return [c for c in columns if c not in HIDDEN[name]]


def response(rows: DataFrame, name: str) -> DataFrame:
    """The answered form of an evidence table. Only the answered columns are read from files."""
    kinds = dict(rows.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    return rows.select(*[F.to_json(c).alias(c) if nested(c) else F.col(c) for c in answered_columns(name)])
