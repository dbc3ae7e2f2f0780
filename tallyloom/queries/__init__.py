"""Named queries over the parquet tables of a data folder, and their SQL."""

from __future__ import annotations

from tallyloom.queries import coverage, documents, further, general, more, relational

QUERIES = {**general.QUERIES, **coverage.QUERIES, **documents.QUERIES, **more.QUERIES, **further.QUERIES, **relational.QUERIES}
SQL = {**general.SQL, **coverage.SQL, **documents.SQL, **more.SQL, **further.SQL, **relational.SQL}
