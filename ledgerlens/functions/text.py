"""String helpers with PostgreSQL NULL and blank semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.util import as_col


def concat_pg(*parts) -> Column:
    """``CONCAT`` that treats NULL as the empty string, as PostgreSQL does.

    Spark's ``concat`` returns NULL for any NULL input, and ``concat_ws``
    drops the separator next to a NULL, so neither matches.
    """
    return F.concat(*[F.coalesce(as_col(p), F.lit("")) for p in parts])


def collapse_blanks(s) -> Column:
    """Turn every run of blanks into one blank and trim both ends.

    The three replaces are the exact chain the source queries use; a regex is
    not equivalent when the text itself contains ``<`` or ``>``.
    """
    s = as_col(s)
    step = F.replace(s, F.lit(" "), F.lit("<>"))
    step = F.replace(step, F.lit("><"), F.lit(""))
    step = F.replace(step, F.lit("<>"), F.lit(" "))
    return F.trim(step)


def json_items(text) -> tuple[Column, Column]:
    """What JSON ``text`` holds (``array``, ``object``, ``scalar``, ``null`` or
    ``malformed``; NULL for a NULL text) and how many items: an array's length, 1
    for an object or a scalar that stands for a list of itself, 0 for JSON null,
    NULL for text that is not JSON.

    PostgreSQL's ``JSON_ARRAY_LENGTH`` raises an error for all but arrays, and
    Spark's gives NULL for them alike, which hides broken text.
    """
    text = as_col(text)
    value = F.try_parse_json(text)
    length = F.array_size(F.try_variant_get(value, "$", "array<variant>"))
    kind = F.schema_of_variant(value)
    what = (F.when(text.isNull(), F.lit(None).cast("string"))
            .when(value.isNull(), "malformed")
            .when(F.is_variant_null(value), "null")
            .when(kind.startswith("ARRAY"), "array")
            .when(kind.startswith("OBJECT"), "object")
            .otherwise("scalar"))
    return what, F.when(what == "array", length).when(what.isin("object", "scalar"), 1).when(what == "null", 0)
