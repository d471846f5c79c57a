"""Name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(fname: str | Column = "fname", lname: str | Column = "lname") -> Column:
    """``fname || ' ' || lname``; NULL if either part is NULL (SQL ``||``)."""
    return F.concat(F.col(fname) if isinstance(fname, str) else fname,
                    F.lit(" "),
                    F.col(lname) if isinstance(lname, str) else lname)


def split_name(name: str | Column, sep: str) -> tuple[Column, Column]:
    """First and second ``sep``-separated part ('' when there is none)."""
    c = F.col(name) if isinstance(name, str) else name
    return (F.split_part(c, F.lit(sep), F.lit(1)),
            F.split_part(c, F.lit(sep), F.lit(2)))
