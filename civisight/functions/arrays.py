"""Delimited lists, pairs and content keys."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civisight.functions.text import ColumnOrName, as_col


def owners(c: ColumnOrName) -> Column:
    """``name|document|share; ...`` to an array of structs; empty entries dropped."""
    def owner(chunk: Column) -> Column:
        parts = F.split(chunk, r"\|")
        part = lambda i: F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit(""))
        return F.struct(part(0).alias("name"), part(1).alias("document"), part(2).alias("share"))

    chunks = F.filter(F.transform(F.split(F.coalesce(as_col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(chunks, owner), lambda o: (o["name"] != "") | (o["document"] != "") | (o["share"] != ""))


def owner_names(c: ColumnOrName) -> Column:
    return F.filter(F.transform(owners(c), lambda o: o["name"]), lambda n: n != "")


def first_owner(c: ColumnOrName) -> Column:
    return F.try_element_at(owner_names(c), F.lit(1))


def share_number(c: ColumnOrName) -> Column:
    """Share text with a decimal comma as a double, null when unreadable."""
    return F.replace(F.trim(as_col(c)), F.lit(","), F.lit(".")).try_cast("double")


def pair_up(a: ColumnOrName) -> Column:
    """Consecutive items (role, name, role, name, ...) to structs; an odd last item is dropped."""
    items = as_col(a)
    starts = F.when(F.size(items) >= 2, F.sequence(F.lit(1), F.size(items) - 1, F.lit(2)))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at(items, i).alias("role"), F.element_at(items, i + 1).alias("name")),
    )


def union_distinct(a: ColumnOrName) -> Column:
    """Order-preserving distinct of the non-empty elements."""
    return F.array_distinct(F.filter(as_col(a), lambda x: x.isNotNull() & (x != "")))


def short_id(c: ColumnOrName, n: int = 16, prefix: str = "") -> Column:
    key = F.substring(F.sha1(as_col(c).cast("binary")), 1, n)
    return F.concat(F.lit(prefix), key) if prefix else key


def content_hash(c: ColumnOrName) -> Column:
    return F.sha2(as_col(c).cast("binary"), 256)
