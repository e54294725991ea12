"""JSON inside model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def extract(c: Column) -> Column:
    """The JSON text of a reply, or null: the whole, a fenced block, the widest {...} or [...]."""
    raw = strip(c)
    fence = strip(F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n(.*?)```", 1))
    pick = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(pick(raw), pick(fence), pick(F.regexp_extract(raw, r"(?s)\{.*\}", 0)), pick(F.regexp_extract(raw, r"(?s)\[.*\]", 0)))


def unfenced(c: Column) -> Column:
    """Without the fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parsed(c: Column, schema: str) -> Column:
    """Schema-on-read with nulls for what does not fit."""
    return F.from_json(extract(c), schema, {"mode": "PERMISSIVE"})
