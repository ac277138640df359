"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxatrend.functions.numeric import round_int

BANDS = ["absent", "trivial", "short", "substantive"]


# Fixed value: the characters trimmed from both ends of a value (blank, control, Unicode space and byte-order mark).
SPACE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_space(s: Column) -> Column:
    """Trim every kind of leading and trailing white space, not only blanks."""
    return F.btrim(s, F.lit(SPACE))


def text_band(value: Column) -> Column:
    """How much substance a free-text value carries."""
    t = trim_space(value)
    words = F.regexp_count(t, F.lit("[A-Za-z]{2,}"))
    return (
        F.when(t.isNull() | (t == ""), "absent")
        .when((words == 0) | (F.length(t) < 3), "trivial")
        .when((F.length(t) < 20) | (words < 3), "short")
        .otherwise("substantive")
    )


def display_name(vernacular: Column, scientific: Column) -> Column:
    return F.when(
        F.coalesce(vernacular, F.lit("")) != "",
        F.concat(vernacular, F.lit(" ("), F.coalesce(scientific, F.lit("null")), F.lit(")")),
    ).otherwise(F.coalesce(scientific, F.lit("unnamed taxon")))


def change_text(x: Column) -> Column:
    """A fractional change as '+12%'; 'n/a' when unknown."""
    body = F.concat(F.when(x > 0, "+").otherwise(""), round_int(x * 100).cast("string"), F.lit("%"))
    return F.when(x.isNull(), "n/a").otherwise(body)


def ratio_text(x: Column) -> Column:
    """A ratio as a signed percentage change; 'n/a' when unknown."""
    body = F.concat(F.when(x >= 1, "+").otherwise(""), round_int((x - 1) * 100).cast("string"), F.lit("%"))
    return F.when(x.isNull(), "n/a").otherwise(body)


def signed_percent(x: Column, base: float) -> Column:
    """Display form with a true minus sign: base 1 for ratios, 0 for changes; a dash when unknown."""
    sign = F.when(x >= base, "+").otherwise("−")
    body = F.concat(sign, F.abs(round_int((x - F.lit(base)) * 100)).cast("string"), F.lit("%"))
    return F.when(x.isNull(), "—").otherwise(body)


def count_text(n: Column, digits: int = 0) -> Column:
    """A number with thousands separators; a dash when unknown."""
    body = F.format_number(n, digits)
    if digits:
        body = F.regexp_replace(body, r"\.?0+$", "")
    return F.when(n.isNull(), "—").otherwise(body)


def mention_form(s: Column) -> Column:
    """Lower case with hyphens opened up, the form names and summaries are compared in."""
    return F.regexp_replace(F.lower(s), "[-‐]", " ")
