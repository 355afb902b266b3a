"""Values as people read them, and people's values as numbers. Column expressions without loss of nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions.calendar import MONTHS, long_date
from lonja.functions.text import deaccent

#: What stands for a missing figure.
NOTHING = "—"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: str | Column, places: int = 4) -> Column:
    """Half away from zero in decimals, as a double; null and NaN are null."""
    return F.round(F.nanvl(col(x).cast("double"), F.lit(None)).cast("decimal(24,8)"), places).cast("double")


def _digits(x: str | Column, places: int) -> Column:
    return F.round(F.nanvl(col(x).cast("double"), F.lit(None)).cast("decimal(24,8)"), places).cast(f"decimal(22,{places})").cast("string")


def soles(x: str | Column) -> Column:
    """"S/ 3.50"; "S/ —" without value."""
    return F.concat(F.lit("S/ "), F.coalesce(_digits(x, 2), F.lit(NOTHING)))


def percent(x: str | Column, places: int = 1) -> Column:
    """"+3.2%": a sign before a rise too; "—" without value."""
    return F.coalesce(F.concat(F.when(col(x) > 0, "+").otherwise(""), _digits(x, places), F.lit("%")), F.lit(NOTHING))


def tonnes(x: str | Column, spaced: bool = True) -> Column:
    """"1 862 t", or "1862 t" unspaced; "— t" without value."""
    whole = _digits(x, 0)
    whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", " ") if spaced else whole
    return F.concat(F.coalesce(whole, F.lit(NOTHING)), F.lit(" t"))


def match_key(text: str | Column) -> Column:
    """Upper case, no marks, single blanks: the key by which the names of two sources meet."""
    return F.trim(F.regexp_replace(F.upper(deaccent(text)), r"\s+", " "))


def titled(text: str | Column) -> Column:
    """Every run of letters begins in upper case, also after marks and brackets; all else in lower case."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def report_number(text: str | Column) -> Column:
    """The report's figures: commas part thousands, and whatever is no figure or point is dropped."""
    kept = F.regexp_replace(F.replace(col(text), F.lit(","), F.lit("")), r"[^0-9.]", "")
    return kept.try_cast("double")


def plain_number(text: str | Column) -> Column:
    """The other sources' figures: a comma is the decimal mark, and anything else beside a figure makes it none."""
    t = F.trim(col(text))
    return F.when(t.rlike(r"^-?[0-9]+(?:[.,][0-9]+)?$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def short_date(d: str | Column) -> Column:
    """"7 de agosto"."""
    d = col(d)
    return F.concat(F.dayofmonth(d), F.lit(" de "), F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1))


def period_label(period: str | Column, grain: str, first: str | Column, last: str | Column) -> Column:
    """How a text calls a day, week or month; a week by the days that it has data of."""
    if grain == "dia":
        return long_date(first)
    if grain == "mes":
        return F.concat(F.get(F.array(*map(F.lit, MONTHS)), F.month(first) - 1), F.lit(" de "), F.year(first))
    if grain == "semana":
        days = F.when(col(first) == col(last), short_date(first)).otherwise(F.concat(F.lit("del "), short_date(first), F.lit(" al "), short_date(last)))
        return F.concat(F.lit("semana "), col(period), F.lit(" ("), days, F.lit(")"))
    raise ValueError(f"unknown grain {grain}")


def direction(change: str | Column) -> Column:
    """sube, baja, igual; null without change."""
    sign = F.signum(col(change).cast("double"))
    return F.when(sign > 0, "sube").when(sign < 0, "baja").when(sign == 0, "igual")


def clamped(x: str | Column, most: int, least: int = 1) -> Column:
    """Between least and most; null stays."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(least), F.least(col(x), F.lit(most))))


def stale_hours(last: str | Column, made: str | Column) -> Column:
    """Whole hours from the end of the last day with data until `made`."""
    ends = F.date_add(col(last), 1).cast("timestamp")
    return F.floor((F.unix_timestamp(col(made).cast("timestamp")) - F.unix_timestamp(ends)) / 3600).cast("bigint")


def bare_statement(answer: str | Column) -> Column:
    """The SQL statement of an answer: without a fence around it, words before it, and a closing semicolon."""
    t = F.regexp_replace(F.trim(col(answer)), r"^```[A-Za-z]*\s*|\s*```$", "")
    from_verb = F.regexp_extract(t, r"(?is)\b(?:select|with)\b.*", 0)
    return F.trim(F.regexp_replace(F.when(from_verb != "", from_verb).otherwise(t), r"[;\s]+$", ""))


def states_a_price(text: str | Column) -> Column:
    """Whether a text puts a price to something, in soles."""
    return col(text).rlike(r"(?i)S/\s*\d|\d+(?:[.,]\d+)?\s*soles")


def signature_file(provider: str, model: str, dims: int) -> str:
    """The name of the folder that holds the vectors of one embedder, safe on any file system."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", f"{provider}:{model}:{dims}")
