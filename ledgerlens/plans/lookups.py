"""Lookups by a key that should be unique, checked while they run.

A LEFT JOIN to a lookup table keeps the rows of its left side one to one only if
the key is unique there. ``left_lookup`` counts the rows that go into and come
out of the join, and NULL keys on both sides, with ``DataFrame.observe``: the
numbers are gathered by the tasks that do the join, without another pass. After
the action that ran the plan, ``LookupChecks.verify`` reports or raises.

Counts are those of the tasks that ended well, so lost executors do not change
them. An action that does not read all rows (``limit``, ``first``) gives counts
of what it read; repeated keys still show as soon as one has matched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RepeatedKey(ValueError):
    """A lookup matched some rows more than once."""


@dataclass
class LookupChecks:
    """The lookups of one plan. Use a new one for every plan that is run."""

    found: dict[str, tuple[Observation, Observation, Observation]] = field(default_factory=dict)

    def report(self) -> dict[str, dict[str, int]]:
        """For each lookup: rows in, rows out, rows added by repeated keys, and
        NULL keys on either side. Waits for the plan's first action to end."""
        out = {}
        for name, (left, right, joined) in self.found.items():
            a, b, c = left.get, right.get, joined.get
            out[name] = {"rows_in": a["rows"], "rows_out": c["rows"], "added": c["rows"] - a["rows"],
                         "null_keys": a["null_keys"], "lookup_rows": b["rows"], "lookup_null_keys": b["null_keys"]}
        return out

    def verify(self) -> dict[str, dict[str, int]]:
        """The report; raises :class:`RepeatedKey` if a lookup added rows."""
        report = self.report()
        if bad := {n: r["added"] for n, r in report.items() if r["added"] > 0}:
            raise RepeatedKey(f"rows added by repeated lookup keys: {bad}")
        return report


def left_lookup(left: DataFrame, right: DataFrame, key: str, right_key: str, name: str, checks: LookupChecks | None) -> DataFrame:
    """``left LEFT JOIN right ON key = right_key``, observed as ``name`` where
    ``checks`` is given. A lookup row with a NULL key never matches."""
    on = F.col(key) == F.col(right_key)
    if checks is None:
        return left.join(right, on, "left")
    if name in checks.found:
        raise ValueError(f"lookup {name} is already checked")

    def numbers(k: str) -> tuple[Column, Column]:
        return F.count(F.lit(1)).alias("rows"), F.count_if(F.col(k).isNull()).alias("null_keys")

    checks.found[name] = seen = tuple(Observation(f"{name}-{part}") for part in ("left", "right", "joined"))
    joined = left.observe(seen[0], *numbers(key)).join(right.observe(seen[1], *numbers(right_key)), on, "left")
    return joined.observe(seen[2], *numbers(key))
