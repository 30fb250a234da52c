"""All registered queries and, by the same names, their SQL."""

from __future__ import annotations

from . import annotated, counted, fits, reported, splicing

QUERIES: dict = {**splicing.QUERIES, **fits.QUERIES}
ORACLE_SQL: dict[str, str] = dict(splicing.ORACLE_SQL)

#: Their queries register themselves with those of ``splicing``.
REGISTERED = (annotated, counted, reported)
