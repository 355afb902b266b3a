"""Calendar expressions: periods, Spanish dates, public holidays and business days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Months and weekdays (from Monday) in Spanish.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
#: Peru's holidays of fixed date, as (month, day).
FIXED = ((1, 1), (5, 1), (6, 7), (6, 29), (7, 23), (7, 28), (7, 29), (8, 6), (8, 30), (10, 8), (11, 1), (12, 8), (12, 9), (12, 25))


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon = epact - (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
    sunday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    ahead = moon - sunday
    month = 3 + (ahead + 40) // 44
    return date(year, month, ahead + 28 - 31 * (month // 4))


def holidays(first: int, last: int) -> list[date]:
    """Public holidays of the years: those of fixed date, Maundy Thursday and Good Friday."""
    out = []
    for y in range(first, last + 1):
        out += [date(y, m, d) for m, d in FIXED] + [easter(y) - timedelta(3), easter(y) - timedelta(2)]
    return sorted(out)


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """One row for each day of the years: fecha, feriado, habil, hasta_feriado (days to the next holiday, at most 30)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(first, 1, 1)), F.lit(date(last, 12, 31)))).alias("fecha"))
    off = spark.createDataFrame([(d,) for d in holidays(first, last + 1)], "_h date")
    rows = days.join(F.broadcast(off), F.col("fecha") == F.col("_h"), "left").withColumn("feriado", F.col("_h").isNotNull())
    ahead = F.min("_h").over(Window.orderBy("fecha").rowsBetween(0, 30))  # a calendar, not data: some thousand rows
    gap = F.least(F.coalesce(F.datediff(ahead, "fecha"), F.lit(30)), F.lit(30))
    return rows.select("fecha", "feriado", (~F.col("feriado") & (F.weekday("fecha") < 5)).alias("habil"), gap.alias("hasta_feriado"))


def period(d: str | Column, grain: str) -> Column:
    """Key of the day, ISO week or month that a date falls into."""
    d = F.col(d) if isinstance(d, str) else d
    if grain == "dia":
        return F.date_format(d, "yyyy-MM-dd")
    if grain == "semana":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))
    if grain == "mes":
        return F.date_format(d, "yyyy-MM")
    raise ValueError(f"unknown grain {grain}")


def long_date(d: str | Column) -> Column:
    """"lunes 5 de enero de 2026"."""
    d = F.col(d) if isinstance(d, str) else d
    week, month = (F.array(*map(F.lit, names)) for names in (WEEKDAYS, MONTHS))
    return F.concat(F.get(week, F.weekday(d)), F.lit(" "), F.dayofmonth(d), F.lit(" de "), F.get(month, F.month(d) - 1), F.lit(" de "), F.year(d))


def long_date_of(text: str | Column) -> Column:
    """The first long Spanish date in a text ("22 de junio de 2026", "1 setiembre del 2025"); null if there is none or it is impossible."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    pattern = r"(\d{1,2})\s+(?:de\s+)?(" + "|".join((*MONTHS, "septiembre")) + r")\s+(?:del?\s+)?(\d{4})"
    day, name, year = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    names = F.array(*map(F.lit, MONTHS))
    month = F.when(name == "septiembre", 9).otherwise(F.array_position(names, name))
    return F.when(name != "", F.try_to_timestamp(F.format_string("%s-%02d-%02d", year, month.cast("int"), day.try_cast("int")), F.lit("yyyy-MM-dd")).cast("date"))
