"""Words placed on a page, put together into rows and columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lonja.operators.series import Block, map_series


def clustered(words: DataFrame, page: Sequence[str], top: str, x: str, tolerance: float = 3.0) -> DataFrame:
    """words with `renglon`: the row of the page that each word stands in, from 0 downward.

    From the top on (to a tenth), then from the left, each word joins the first row whose first
    word lies within `tolerance` of it, else it opens a row. A page is bounded by its words; pages
    are spread over the tasks. Words with a null place or page are left out.
    """
    present = F.col(top).isNotNull() & F.col(x).isNotNull()
    for c in page:
        present &= F.col(c).isNotNull()
    rows = words.where(present).withColumn("_top", F.floor(F.col(top).cast("double") * 10 + 0.5) / 10)
    rows = rows.withColumn("_i", F.struct("_top", F.col(x).cast("double")))
    names = words.columns
    out = StructType([*words.schema.fields, StructField("renglon", IntegerType())])

    def kernel(b: Block) -> dict:
        row = np.zeros(b.n, np.int32)
        for s, e in zip(b.starts, b.ends):
            anchors: list[float] = []
            for i in range(s, e):
                at = next((j for j, a in enumerate(anchors) if abs(b["_top"][i] - a) <= tolerance), None)
                if at is None:
                    at = len(anchors)
                    anchors.append(b["_top"][i])
                row[i] = at
        return {c: b.columns.column(c) for c in names} | {"renglon": row}

    return map_series(rows, kernel, out, keys=page, order="_i")


def in_bands(words: DataFrame, row: Sequence[str], x: str, text: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each row of words, with the first text of each band of x (low <= x < high); null without one."""
    picks = [F.min_by(text, F.when((F.col(x) >= low) & (F.col(x) < high), F.col(x))).alias(name) for name, (low, high) in bands.items()]
    return words.groupBy(*row).agg(*picks)


def joined(words: DataFrame, row: Sequence[str], x0: str, x1: str, text: str, gap: float = 0.5) -> DataFrame:
    """row, texto: the words of a row from left to right, with a blank where they stand at least `gap` apart."""
    before = F.lag(x1).over(Window.partitionBy(*row).orderBy(x0))
    blank = F.when(F.col(x0) - before >= gap, " ").otherwise("")
    pieces = words.withColumn("_p", F.concat(blank, F.col(text)))
    parts = pieces.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(F.col(x0).alias("x"), "_p"))).alias("_w"))
    return parts.select(*row, F.array_join(F.transform("_w", lambda w: w["_p"]), "").alias("texto"))


def numbers_in_bands(words: DataFrame, row: Sequence[str], at: str, text: str, bands: dict[str, tuple[float, float]], number: Callable[[str], Column]) -> DataFrame:
    """One row for each row of words, with the first figure in each band (low <= at < high), as `number` reads figures."""
    read = words.withColumn("_v", number(text))
    picks = [F.min_by("_v", F.when(F.col("_v").isNotNull() & (F.col(at) >= low) & (F.col(at) < high), F.col(at))).alias(n) for n, (low, high) in bands.items()]
    return read.groupBy(*row).agg(*picks)


def four_masses(cells: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """struct of a value for each band, and `ambiguo`, of cells (array of struct(at, v), from left to right).

    As many cells as bands: by their order, wherever they stand. Else by place, the first with a value in
    each band; more cells than bands, or a further one in a band that has its value, are ambiguous.
    """
    whole = F.size(cells) == len(bands)
    values, extra = [], F.size(cells) > len(bands)
    for i, (name, band) in enumerate(bands.items()):
        inside = F.filter(cells, _between(*band))
        first = F.get(F.filter(inside, lambda c: c["v"].isNotNull()), F.lit(0))
        values.append(F.when(whole, F.get(cells, F.lit(i))["v"]).otherwise(first["v"]).alias(name))
        # A cell after the band's first value is one too many.
        extra |= F.coalesce(F.array_max(F.transform(inside, lambda c: c["at"])) > first["at"], F.lit(False))
    return F.struct(*values, (~whole & extra).alias("ambiguo"))


def _between(low: float, high: float) -> Callable[[Column], Column]:
    return lambda c: (c["at"] >= low) & (c["at"] < high)


#: What a word of a report's row is: A of a name, F a note between name and masses, M a mass or its gap,
#: U of a unit, N a figure, G a figure and letters run together.
GRAMMAR = "^(A+)((?:F[AF]*)?)(M*)(U*)(N{0,3})(.*)$"


def report_rows(words: DataFrame, row: Sequence[str], x0: str, x1: str, text: str, edges: tuple[float, float, float], bands: dict[str, tuple[float, float]], number: Callable[[Column], Column]) -> DataFrame:
    """row, nombre, the masses of `bands`, ambiguo, unidad, and what comes after: equiv, ayer, hoy, media, letras.

    Each word of a row gets a letter by its place (edges: where names end, where masses begin and end)
    and by what it is made of; the letters of a row are read by one pattern, and its groups say which
    words are the name, notes, masses, unit, up to three figures, and the last figure with its trend,
    which run into each other. Rows without a name are none. A row is bounded by the page's width.
    """
    name_end, mass_start, mass_end = edges
    centre = (F.col(x0) + F.col(x1)) / 2
    t = F.col(text)
    alpha, digit = t.rlike(r"\p{L}"), t.rlike(r"\d")
    letters = alpha & ~digit
    kind = F.when((centre < name_end) & letters, "A").when(centre < mass_start, "F").when((centre < mass_end) & ~alpha, "M").when(letters, "U").when(~alpha, "N").otherwise("G")
    held = words.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(F.col(x0).alias("x"), centre.alias("at"), t.alias("t"), kind.alias("k")))).alias("_w"))
    held = held.withColumn("_k", F.array_join("_w.k", ""))
    sizes = [F.length(F.regexp_extract("_k", GRAMMAR, i)) for i in range(1, 7)]
    held = held.where(F.col("_k").rlike(GRAMMAR)).withColumns({f"_n{i}": n for i, n in enumerate(sizes)})

    def group(i: int) -> Column:
        start = F.lit(1)
        for j in range(i):
            start = start + F.col(f"_n{j}")
        return F.slice("_w", start, F.col(f"_n{i}"))

    masses = F.transform(group(2), lambda c: F.struct(c["at"].alias("at"), number(c["t"]).alias("v")))
    figures = F.transform(group(4), lambda c: number(c["t"]))
    price, trend = split_letters(F.array_join(F.transform(group(5), lambda c: c["t"]), ""))
    held = held.select(*row, F.array_join(F.transform(group(0), lambda c: c["t"]), " ").alias("nombre"), four_masses(masses, bands).alias("_m"), F.array_join(F.transform(group(3), lambda c: c["t"]), " ").alias("unidad"), figures.alias("_f"), price.alias("media"), F.nullif(trend, F.lit("")).alias("letras"))
    return held.select(*row, "nombre", "_m.*", F.nullif("unidad", F.lit("")).alias("unidad"), *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(("equiv", "ayer", "hoy"))], "media", "letras")


def bulletin_rows(words: DataFrame, row: Sequence[str], x0: str, x1: str, text: str, code: tuple[float, float], market: tuple[float, float], name: tuple[float, float], price: tuple[float, float], number: Callable[[str], Column], markets: DataFrame) -> DataFrame:
    """row, cnpa, mercado, producto, precio of the rows of a bulletin's grid, by the bands that words lie in.

    A row has a code of five digits, the mark of a market of `markets` (mercado), a price, and a name of
    two letters at least; heads and titles have not. Marks and names may come letter by letter.
    """
    centre = (F.col(x0) + F.col(x1)) / 2
    at = words.withColumn("_c", centre)
    inside = lambda band: (F.col("_c") >= band[0]) & (F.col("_c") < band[1])
    codes = at.where(inside(code) & F.col(text).rlike(r"^\d{5}$")).groupBy(*row).agg(F.min_by(text, x0).alias("cnpa"))
    marks = joined(at.where(inside(market)), row, x0, x1, text, gap=float("inf")).withColumnRenamed("texto", "mercado")
    names = joined(at.where(inside(name)), row, x0, x1, text).select(*row, F.trim(F.regexp_replace("texto", r"\s+", " ")).alias("producto"))
    prices = numbers_in_bands(at, row, "_c", text, {"precio": price}, number)
    known = markets.select("mercado").distinct()
    out = codes.join(marks, list(row)).join(known, "mercado").join(names, list(row)).join(prices, list(row))
    return out.where(F.col("precio").isNotNull() & (F.length("producto") >= 2)).select(*row, "cnpa", "mercado", "producto", "precio")


def longest_prefix(df: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """df with `prefijo`, the longest of the prefixes that its text begins with, and `resto`.

    The prefixes are joined by their first word, which keeps each text to those it can begin with.
    """
    known = prefixes.select(F.col(prefix).alias("prefijo"), F.regexp_extract(prefix, r"^\S+", 0).alias("_w")).distinct()
    rows = df.withColumns({"_id": F.monotonically_increasing_id(), "_w": F.regexp_extract(text, r"^\S+", 0)})
    found = rows.join(known, "_w", "left").withColumn("prefijo", F.when(F.startswith(F.col(text), F.col("prefijo")), F.col("prefijo")))
    best = found.groupBy("_id", *df.columns).agg(F.max(F.struct(F.length("prefijo").alias("n"), "prefijo"))["prefijo"].alias("prefijo"))
    rest = F.when(F.col("prefijo").isNotNull(), F.trim(F.substring(F.col(text), F.length("prefijo") + 1, F.length(text)))).otherwise(F.col(text))
    return best.select(*df.columns, "prefijo", rest.alias("resto"))


def split_letters(text: str | Column) -> tuple[Column, Column]:
    """(number, letters) of a text in which a figure and a word run into each other, as "2.50Estable" or "E2s.t5able"."""
    t = F.col(text) if isinstance(text, str) else text
    number = F.regexp_replace(t, r"[^0-9.]", "").try_cast("double")
    return number, F.regexp_replace(t, r"[^\p{L} ]", "")


def fingerprint(words: DataFrame, doc: Sequence[str], text: str, x: str, keywords: Sequence[str]) -> DataFrame:
    """doc, huella, faltan: the keywords of a page's head in the order they stand in, and those that are missing."""
    found = words.where(F.lower(text).isin(*keywords)).groupBy(*doc, F.lower(text).alias("_k")).agg(F.min(x).alias("_x"))
    seen = words.select(*doc).distinct().join(found.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("_x", "_k"))).alias("_w")), list(doc), "left")
    order = F.coalesce(F.transform("_w", lambda w: w["_k"]), F.array().cast("array<string>"))
    return seen.select(*doc, F.array_join(order, "|").alias("huella"), F.array_except(F.array(*map(F.lit, keywords)), order).alias("faltan"))
