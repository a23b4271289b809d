"""Names, lists in text and tolerant number parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def joined_ids(ids: Column) -> Column:
    """Sorted distinct ids joined with ``;``."""
    return F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ";")


def split_nonempty(text: Column, delimiter: str) -> Column:
    return F.filter(F.split(text, re.escape(delimiter)), lambda part: part != "")


def case_distance(case: Column) -> Column:
    """Distance named by ``_d<digits>_`` in a case label; a label without one is an error."""
    digits = F.regexp_extract(case, r"_d(\d+)_", 1)
    return F.when(
        digits == "", F.raise_error(F.concat(F.lit("no distance in case label: "), case)).cast("int")
    ).otherwise(digits.cast("int"))


def case_label(rounds: Column, distance: Column, noise: Column) -> Column:
    """``r<rounds>_d<distance>_p<noise in 1/10000, half up>``."""
    scaled = F.floor(noise * 10000.0 + 0.5).cast("string")
    return F.concat(
        F.lit("r"), rounds.cast("string"), F.lit("_d"), distance.cast("string"), F.lit("_p"), scaled
    )


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(0.0))


def first_number(*texts: Column) -> Column:
    """First non-empty text as a number, 0 when all are empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit("0")).cast("double")


def probability_text(p: Column) -> Column:
    return F.format_string("%.4f", p)


def render_case_name(template: Column, distance: Column, rounds: Column, seed: Column, shots: Column, p: Column) -> Column:
    """Fill ``{distance} {rounds} {seed} {shots} {p} {p4}`` in a case-name template."""
    out = template
    for name, value in (("distance", distance), ("rounds", rounds), ("seed", seed), ("shots", shots)):
        out = F.replace(out, F.lit("{%s}" % name), value.cast("string"))
    out = F.when(p.isNull(), out).otherwise(
        F.replace(F.replace(out, F.lit("{p}"), p.cast("string")), F.lit("{p4}"), probability_text(p))
    )
    return out


def state_name(state: Column) -> Column:
    """Text of an execution state code."""
    # Names of the execution states by code.
    names = ["RUNNING", "QUIESCENT_STOPPED", "DRAINED_WITH_LIVE_ALT_TREE", "IMPORTED_INTO_PARENT"]
    expr = F.lit("UNKNOWN")
    for code, name in enumerate(names):
        expr = F.when(state == code, name).otherwise(expr)
    return expr
