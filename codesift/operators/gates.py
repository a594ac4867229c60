"""Text gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import js_length, js_trim

# Prompt length bounds (after trimming).
PROMPT_MIN, PROMPT_MAX = 10, 1000


def sanitize(text: Column) -> Column:
    """Trim JavaScript whitespace at both ends (Spark's trim cuts spaces only)."""
    return js_trim(text)


def prompt_gate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`ok` and `reason` per prompt; too short / too long after trimming."""
    n = js_length(js_trim(F.col(text_col)))  # UTF-16 units, as the editor counts
    reason = (F.when(n < PROMPT_MIN, F.lit("too_short"))
              .when(n > PROMPT_MAX, F.lit("too_long")))
    return df.select("*", n.cast("int").alias("trimmed_len"), reason.isNull().alias("ok"), reason.alias("reason"))
