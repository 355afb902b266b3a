"""All queries and their SQL but those of the text subpackage."""

from lonja.plans import facade, general, more, pages, rankings, reference, scalars, stored

MODULES = (general, reference, more, scalars, pages, rankings, stored, facade)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
