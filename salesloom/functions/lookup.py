"""Constant dictionaries as Column lookups."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(mapping: dict, value_type: str = "string") -> Column:
    """A fixed dictionary as one constant map column (folded at planning time)."""
    text = json.dumps(mapping, ensure_ascii=True)
    return F.from_json(F.lit(text), f"map<string,{value_type}>")


def look_up(mapping: dict, key: Column, value_type: str = "string") -> Column:
    """The mapped value, or NULL for an unknown or NULL key."""
    return F.try_element_at(literal_map(mapping, value_type), key)


def ladder(mapping: dict, key: Column, default, value_type: str = "double") -> Column:
    """A short dictionary as a CASE chain, which stays in generated code."""
    out = None
    for name, value in mapping.items():
        cond = key == F.lit(name)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default)).cast(value_type)
