"""Ages, waiting times and tiers as column expressions; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
LIMIT_MARGIN_S, MAX_LIMIT_WAIT_S = 90, 6 * 3600

def age(born: Column, died: Column) -> Column:
    """R14. Years and days between two dates in words; a zero part is left out unless both are zero; 29 February counts as the 28th in common years."""
    md = lambda x: F.month(x) * 100 + F.dayofmonth(x)
    years = F.year(died) - F.year(born) - F.when(md(died) < md(born), 1).otherwise(0)
    days = F.datediff(died, F.add_months(born, years * 12))
    return F.concat_ws(", ", F.when(years != 0, F.concat(years.cast("string"), F.lit(" vjet"))), F.when((days != 0) | (years == 0), F.concat(days.cast("string"), F.lit(" ditë"))))


def reset_wait(text: Column, now: Column) -> Column:
    """Q07. Seconds until the time of day behind ``resets``, with the margin; null without one or over six hours.

    The time counts in the zone in brackets behind it (``(Europe/Berlin)``), in the session's where none is.
    """
    said = F.lower(F.regexp_extract(text, r"(?i)resets\s+([0-9:]+\s*[ap]m)", 1))
    clock = F.replace(F.replace(said, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))
    clock = F.when(F.contains(clock, F.lit(":")), clock).otherwise(F.regexp_replace(clock, "([ap])", ":00$1"))
    zone = F.nullif(F.regexp_extract(text, r"(?i)resets\s+[0-9:]+\s*[ap]m\s*\(([A-Za-z]+/[A-Za-z_]+|UTC)\)", 1), F.lit(""))
    here = F.coalesce(F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), zone), now)
    at = F.try_to_timestamp(F.concat_ws(" ", F.date_format(here, "yyyy-MM-dd"), F.upper(clock)), F.lit("yyyy-MM-dd h:mma"))
    ahead = F.pmod(F.unix_timestamp(at) - F.unix_timestamp(here) - 1, F.lit(86400)) + 1 + LIMIT_MARGIN_S
    return F.when(ahead <= MAX_LIMIT_WAIT_S, ahead)


def tier(text_is_complex: Column, model: Column, complex_model: Column) -> Column:
    """F14. The model for complex chunks where one is named and the chunk is complex."""
    return F.when(text_is_complex & (F.coalesce(complex_model, F.lit("")) != ""), complex_model).otherwise(model)
