"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the plain letters in the same places.
MARKED = "áàâäãåāăąÁÀÂÄÃÅĀĂĄéèêëēĕėęěÉÈÊËĒĔĖĘĚíìîïĩīĭįÍÌÎÏĨĪĬĮóòôöõōŏőÓÒÔÖÕŌŎŐúùûüũūŭůűųÚÙÛÜŨŪŬŮŰŲñńņňÑŃŅŇçćĉċčÇĆĈĊČýÿŷÝŸŶšśŝşŠŚŜŞžźżŽŹŻ"
PLAIN = "aaaaaaaaaAAAAAAAAAeeeeeeeeeEEEEEEEEEiiiiiiiiIIIIIIIIooooooooOOOOOOOOuuuuuuuuuuUUUUUUUUUUnnnnNNNNcccccCCCCCyyyYYYssssSSSSzzzZZZ"


def deaccent(c: str | Column) -> Column:
    """Letters without their marks, whether composed or followed by combining marks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[̀-ͯ]", "")


def normalised(c: str | Column) -> Column:
    """Lower case, no marks, single spaces."""
    return F.trim(F.regexp_replace(F.lower(deaccent(c)), r"\s+", " "))


def slug(c: str | Column) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens."""
    return F.trim(F.lower(F.regexp_replace(deaccent(c), "[^a-zA-Z0-9]+", "-")), F.lit("-"))


def tokens(c: str | Column) -> Column:
    """Words of a-z and 0-9 of the normalised text."""
    return F.filter(F.split(normalised(c), "[^a-z0-9]+"), lambda t: t != "")
