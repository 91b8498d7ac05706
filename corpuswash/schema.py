"""The one long-form row that findings of every family share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<family:string,category:string,location:string,label:string,value:string,codepoint:int,count:bigint,size_bytes:bigint,ordinal:int>"
FINDINGS = f"array<{FINDING}>"


def finding(family: str, category: Column | None = None, location: Column | None = None, label: Column | None = None, value: Column | None = None, codepoint: Column | None = None, count: Column | None = None, size_bytes: Column | None = None, ordinal: Column | None = None) -> Column:
    """A finding struct; columns that do not apply are null."""
    given = {"category": category, "location": location, "label": label, "value": value}
    fields = [F.lit(family).alias("family")]
    fields += [(c if c is not None else F.lit(None)).cast("string").alias(n) for n, c in given.items()]
    numbers = {"codepoint": (codepoint, "int"), "count": (count, "bigint"), "size_bytes": (size_bytes, "bigint"), "ordinal": (ordinal, "int")}
    fields += [(c if c is not None else F.lit(None)).cast(t).alias(n) for n, (c, t) in numbers.items()]
    return F.struct(*fields)


def none() -> Column:
    return F.array().cast(FINDINGS)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
