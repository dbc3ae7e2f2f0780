"""Reading SQL statements: the operation, and the tables it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading keyword -> operation.
VERBS = {"select": "read", "insert": "create", "update": "update", "delete": "delete"}

# Schemas and names of system catalogues.
CATALOGUES = ("information_schema", "pg_catalog", "sys")
SYSTEM_NAME = r"^(?:pg_|sqlite_|sql_)|^dual$"

_NAME = r'[`"\[]?([A-Za-z_][A-Za-z0-9_$]*)[`"\]]?'
_TABLE = rf"(?i)\b(?:from|into|update|join)\s+(?:{_NAME}\s*\.\s*)?{_NAME}"


def statement_operation(sql: Column) -> Column:
    """The operation of a statement by its first word; null for what is no data statement."""
    verb = F.lower(F.regexp_extract(sql, r"^\s*(?:\(\s*)*([A-Za-z]+)", 1))
    out = F.lit(None).cast("string")
    for word, op in VERBS.items():
        out = F.when(verb == word, op).otherwise(out)
    return out


def statement_tables(sql: Column) -> Column:
    """The tables of a statement, as an array of struct ``schema, name``; catalogues are left out."""
    schemas, names = (F.regexp_extract_all(sql, F.lit(_TABLE), F.lit(k)) for k in (1, 2))
    both = F.arrays_zip(schemas.alias("schema"), names.alias("name"))
    return F.array_distinct(F.filter(both, lambda t: ~F.lower(t["schema"]).isin(*CATALOGUES) & ~F.lower(t["name"]).rlike(SYSTEM_NAME)))


def statement_bindings(events: DataFrame, sql: str = "statement") -> DataFrame:
    """``events`` with a row per table a statement touches: ``entity, operation``; the verb applies to every table."""
    read = events.withColumn("operation", statement_operation(F.col(sql))).where("operation is not null")
    return read.withColumn("_t", F.explode(statement_tables(F.col(sql)))).withColumn("entity", F.lower("_t.name")).drop("_t")


def created_tables(sql: Column) -> Column:
    """The tables that the statements of a script create, comments and quoted texts left aside."""
    bare = F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'", " ")
    return F.regexp_extract_all(bare, F.lit(r'(?i)(?:^|;)\s*create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?((?:[`"\[]?\w+[`"\]]?\s*\.\s*)?[`"\[]?\w+[`"\]]?)\s*\('), 1)
