"""Column expressions that bring names, expressions, lists and types to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_brackets(name: Column) -> Column:
    """A name without outer blanks and without pairs of square brackets around it, however
    often repeated; a bracket that only one end has stays."""
    e = F.trim(name)
    left = F.length(F.regexp_extract(e, r"^\[*", 0))
    right = F.length(F.replace(F.regexp_extract(e, r"(?:\] *)*$", 0), F.lit(" ")))
    # one step per pair that both ends have; most names have none and are not searched
    inner = F.aggregate(F.array_repeat(F.lit(0), F.least(left, right)), e, lambda acc, _: F.rtrim(F.substr(acc, F.lit(2), F.length(acc) - 2)))
    return F.when(e.startswith("["), inner).otherwise(e)


def bracketed(name: Column) -> Column:
    return F.concat(F.lit("["), strip_brackets(name), F.lit("]"))


def strip_parens(expression: Column) -> Column:
    """An expression without redundant outer parentheses; `(a)+(b)` keeps its own.

    With L opening ones in front, R closing ones behind and m the lowest depth that the
    text between reaches, min(L, R, m) pairs enclose everything."""
    e = F.trim(expression)
    left = F.length(F.regexp_extract(e, r"^\(*", 0))
    right = F.length(F.regexp_extract(e, r"\)*$", 0))
    core = F.substr(e, left + 1, F.greatest(F.length(e) - left - right, F.lit(0)))
    start = F.struct(left.alias("now"), left.alias("low"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.least(acc["low"], now).alias("low"))

    low = F.aggregate(F.filter(F.split(core, ""), lambda c: (c == "(") | (c == ")")), start, step, lambda acc: acc["low"])
    pairs = F.greatest(F.least(left, right, low), F.lit(0))
    # nothing but parentheses has no text between
    return F.when(F.length(e) == left, e).otherwise(F.trim(F.substr(e, pairs + 1, F.length(e) - 2 * pairs)))


def column_list(text: Column, keep_order: bool = True) -> Column:
    """A comma-separated list as an array of bare names; DESC stays as a suffix."""
    def part(x: Column) -> Column:
        bare = F.trim(x)
        down = F.upper(bare).endswith(" DESC")
        name = strip_brackets(F.regexp_replace(bare, r"(?i)\s+(asc|desc)$", ""))
        return F.when(down, F.concat(name, F.lit(" DESC"))).otherwise(name)

    names = F.filter(F.transform(F.split(text, ","), part), lambda x: x != "")
    return names if keep_order else F.array_sort(names)


def type_string(base: Column, length: Column, precision: Column, scale: Column, identity: Column | None = None) -> Column:
    """The type as it is declared: VARCHAR(10), VARCHAR(MAX) for -1, DECIMAL(12, 3)."""
    name = F.upper(base)
    sized = name.isin("CHAR", "VARCHAR", "NCHAR", "NVARCHAR", "BINARY", "VARBINARY")
    out = F.when(sized, F.concat(name, F.lit("("), F.when(length == -1, F.lit("MAX")).otherwise(length.cast("string")), F.lit(")")))
    out = out.when(name.isin("DECIMAL", "NUMERIC"), F.concat(name, F.lit("("), precision.cast("string"), F.lit(", "), scale.cast("string"), F.lit(")")))
    out = out.when(name.isin("DATETIME2", "DATETIMEOFFSET", "TIME"), F.concat(name, F.lit("("), scale.cast("string"), F.lit(")"))).otherwise(name)
    return out if identity is None else F.concat(out, F.when(identity.isNotNull(), F.concat(F.lit(" IDENTITY("), identity, F.lit(")"))).otherwise(""))


def mask(column: Column, function: str, kind: str) -> Column:
    """A column under its declared mask. default() hides by type; email() keeps the first
    letter; anything else is left as it is."""
    name = function.strip().lower()
    if name == "email()":
        return F.concat(F.substring(column, 1, 1), F.lit("XXX@XXXX.com"))
    if name == "default()":
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.when(column.isNotNull(), F.lit("1900-01-01").cast(kind))
        if kind == "string":
            return F.when(column.isNotNull(), F.lit("xxxx"))
        return F.when(column.isNotNull(), F.lit(0).cast(kind))
    return column


#: Collations by the ending of the declared name.
COLLATIONS = {"_CI_AS": "UNICODE_CI", "_CS_AS": "UTF8_BINARY", "_BIN": "UTF8_BINARY", "_BIN2": "UTF8_BINARY"}


def collated(column: Column, declared: str) -> Column:
    """A column with the comparison rule of a declared collation; IGNORE leaves it alone."""
    if declared.upper() == "IGNORE":
        return column
    for ending, rule in COLLATIONS.items():
        if declared.upper().endswith(ending):
            return F.collate(column, rule)
    return column
