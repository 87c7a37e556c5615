"""Answers in free text as Columns: segments with times and captions, in the two layouts that are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the layouts.
LINE = r"(?s)(?:\*\*Start Time:\*\*|Start\s*\(?Time\)?|Time\s*Range:|Time\s*Interval:|^)\s*(\d+\.?\d*)\s*[-–]\s*(\d+\.?\d*)\s*seconds?.*?(?:\*\*Description:\*\*|-)\s*(.+)$"
SPAN = r"(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\s+seconds?:"
BLANKS = "[ \t\r\n\x0b\x0c]"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def _segment(start: Column, end: Column, caption: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), caption.alias("caption"))


def line_segments(text: Column) -> Column:
    """array of start, end, caption: one for each line with a range of seconds and, behind a dash or a mark, a caption; points at its end go.

    Null and empty texts, and lines of other forms, have none.
    """
    lines = F.filter(F.split(_stripped(F.coalesce(text, F.lit(""))), "\n"), lambda line: line.rlike(LINE))
    part = lambda line, k: F.regexp_extract(line, LINE, k)
    return F.transform(lines, lambda line: _segment(part(line, 1), part(line, 2), F.regexp_replace(_stripped(part(line, 3)), r"\.+$", "")))


def span_segments(text: Column) -> Column:
    """array of start, end, caption: from each `a-b seconds:` to the next one at a line's beginning, or the text's end; without empty captions, with repeated ones."""
    found = F.regexp_extract_all(_stripped(F.coalesce(text, F.lit(""))), F.lit(rf"(?s){SPAN}\s+.*?(?=\n{SPAN}|\z)"), F.lit(0))  # the text is gone through once
    part = lambda x, k: F.regexp_extract(x, rf"(?s)^{SPAN}\s+(.*)\z", k)
    return F.filter(F.transform(found, lambda x: _segment(part(x, 1), part(x, 2), _stripped(part(x, 3)))), lambda s: s["caption"] != "")
