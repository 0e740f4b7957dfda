"""Column-expression helpers shared by the operators (all JVM-side)."""

from ledgerlens.functions.money import usd, usd_or_zero  # noqa: F401
from ledgerlens.functions.text import collapse_blanks, concat_pg, json_items  # noqa: F401
from ledgerlens.functions.timefn import (  # noqa: F401
    age_intervals, age_months, age_parts, as_of_lit, date_to_pst, month_start, to_pst,
)
