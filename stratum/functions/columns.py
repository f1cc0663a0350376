"""Clean column names (metadata only; the data plan is a plain projection)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

DEFAULT_PATTERN = r"[^\w]"


def clean_name(name: str, pattern: str = DEFAULT_PATTERN) -> str:
    """Remove every character matching ``pattern`` (Python regex, Unicode ``\\w``)."""
    return re.sub(pattern, "", name)


def clean_columns(df: DataFrame, pattern: str = DEFAULT_PATTERN, on_collision: str = "raise") -> DataFrame:
    """Rename every column by removing the characters matching ``pattern``.

    Names are cleaned with Python ``re`` on the driver because Python's ``\\w`` is
    Unicode-aware. Two names that clean to the same text raise by default;
    ``on_collision="suffix"`` renames the later ones ``name_2``, ``name_3``, ...
    A name that cleans to nothing raises.
    """
    if on_collision not in ("raise", "suffix"):
        raise ValueError("on_collision must be 'raise' or 'suffix'")
    seen: dict[str, int] = {}
    out: list[str] = []
    for original in df.columns:
        name = clean_name(original, pattern)
        if not name:
            raise ValueError(f"column {original!r} has no characters left after cleaning")
        key = name.lower()  # Spark resolves names case-insensitively by default
        if key in seen:
            if on_collision == "raise":
                raise ValueError(f"columns clean to the same name {name!r}")
            seen[key] += 1
            candidate = f"{name}_{seen[key]}"
            while candidate.lower() in seen:
                seen[key] += 1
                candidate = f"{name}_{seen[key]}"
            seen[candidate.lower()] = 1
            name = candidate
        else:
            seen[key] = 1
        out.append(name)
    return df.toDF(*out)
