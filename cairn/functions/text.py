"""Column helpers for line-oriented documents and for the fixed vocabularies of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Evidence levels, strongest first, with their confidence.
LEVELS = ["注释明示", "索引佐证", "字段命名", "业务语义推断", "待确认"]
CONFIDENCE = [0.8, 0.7, 0.6, 0.4, 0.3]

# Where an edge comes from, and what people decided about it.
ORIGIN_LOGICAL = "逻辑FK列"
ORIGIN_DIAGRAM = "ER证据摘录"
PENDING, CONFIRMED, REJECTED = "待确认", "已确认", "驳回"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Drops every character up to U+0020 at both ends, not spaces alone."""
    return F.btrim(col(c), F.lit("".join(map(chr, range(0x21)))))


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def found_all(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def fully(c: Column | str, pattern: str) -> Column:
    """The whole value matches, as rlike alone doesn't ask for."""
    return col(c).rlike(rf"^(?:{pattern})\z")


def cut(c: Column | str, length: int) -> Column:
    return F.substring(col(c), 1, length)


def carried(marker: Column, doc: str = "doc", line: str = "line_no") -> Column:
    """The last non-null marker of the document at or before each line."""
    return F.last(marker, ignorenulls=True).over(Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank.cast("int"))


def confidence_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), rank.cast("int"))


def rank_of(level: Column | str) -> Column:
    """1 for the strongest level; 5 for unknown ones."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), col(level)).cast("int")
    return F.when(place > 0, place).otherwise(5)
