"""Schemas that drift between the files of a feed.

The schema of each file is folded from its records: every field gets the join, in a
type-promotion lattice, of the types seen in the file. Schemas of a feed are put in
order of export, each is compared with the one before, and the differences are logged.
Records are cast to the union of all schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stash

#: Bits of the type-promotion lattice; the join of two types is the OR of their bits. Whole
#: numbers beyond 2**53 and decimals of more than 15 digits are wide: a double can't hold them.
TYPE_BITS = {
    "string": 1, "bigint": 2, "boolean": 4, "object": 8, "array<string>": 16, "array<object>": 32, "array<other>": 64, "array<empty>": 128,
    "wide bigint": 256, "decimal": 512, "wide decimal": 1024, "double": 2048,
}
ARRAYS = 16 | 32 | 64 | 128
NUMBERS = 2 | 256 | 512 | 1024 | 2048
_WIDE = 2**53


def type_bit(v: Column) -> Column:
    """The lattice bit of a variant value's JSON type; 0 for null."""
    said = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "bigint")
    precision = F.regexp_extract(said, r"DECIMAL\((\d+)", 1).cast("int")
    return (
        F.when(v.isNull() | (said == "VOID"), 0)
        .when(said == "STRING", TYPE_BITS["string"])
        .when(said == "BIGINT", F.when((whole > _WIDE) | (whole < -_WIDE), TYPE_BITS["wide bigint"]).otherwise(TYPE_BITS["bigint"]))
        .when(said.startswith("DECIMAL"), F.when(precision > 15, TYPE_BITS["wide decimal"]).otherwise(TYPE_BITS["decimal"]))
        .when(said == "BOOLEAN", TYPE_BITS["boolean"])
        .when(said.startswith("OBJECT"), TYPE_BITS["object"])
        .when(said == "ARRAY<STRING>", TYPE_BITS["array<string>"])
        .when(said.startswith("ARRAY<OBJECT"), TYPE_BITS["array<object>"])
        .when((said == "ARRAY<VOID>") & (F.to_json(v) == "[]"), TYPE_BITS["array<empty>"])
        .when(said.startswith("ARRAY"), TYPE_BITS["array<other>"])
        .otherwise(TYPE_BITS["double"])
    )


def settle(bits: Column) -> Column:
    """An empty array is any array: its bit is dropped where another array type was seen."""
    other = bits.bitwiseAND(ARRAYS & ~TYPE_BITS["array<empty>"]) > 0
    return F.when(other, bits.bitwiseAND(~TYPE_BITS["array<empty>"])).otherwise(bits)


def _json_type(bits: Column) -> Column:
    """Bits in which all numbers are one type, as they are in JSON."""
    return F.when(bits.bitwiseAND(NUMBERS) > 0, bits.bitwiseAND(~NUMBERS).bitwiseOR(TYPE_BITS["bigint"])).otherwise(bits)


def promoted_name(bits: Column) -> Column:
    """The type all values of ``bits`` fit in without losing a digit; string where only text can hold them.

    Whole numbers are bigint. With decimals, or doubles, they are double as long as no
    number is wide; wide decimals, and wide numbers beside doubles, are text.
    """
    numbers = bits.bitwiseAND(~NUMBERS) == 0
    integers, wide = bits.bitwiseAND(~(TYPE_BITS["bigint"] | TYPE_BITS["wide bigint"])) == 0, bits.bitwiseAND(TYPE_BITS["wide bigint"] | TYPE_BITS["wide decimal"]) > 0
    name = F.when(bits == 0, "string").when(integers, "bigint").when(numbers & ~wide, "double")
    for label in ("boolean", "object", "array<string>", "array<object>", "array<other>", "array<empty>"):
        name = name.when(bits == TYPE_BITS[label], label)
    return name.otherwise("string")


def fields_of(files: DataFrame) -> DataFrame:
    """``files`` with ``fields``, the top-level members of ``raw_json`` as a map of variants."""
    return files.withColumn("fields", F.from_json("raw_json", "map<string,variant>"))


def _folded(values: DataFrame) -> DataFrame:
    """``file_no, field_name, bits`` of ``file_no, field_name, v``."""
    return values.select("file_no", "field_name", type_bit(F.col("v")).alias("bit")).where("bit > 0").groupBy("file_no", "field_name").agg(settle(F.bit_or("bit")).alias("bits"))


def file_schemas(files: DataFrame) -> DataFrame:
    """``file_no, field_name, bits``: the fields with a non-null value in each file."""
    return _folded(fields_of(files).select("file_no", F.explode("fields").alias("field_name", "v")))


def nested_schemas(files: DataFrame, depth: int) -> DataFrame:
    """``file_no, field_name, bits`` of the members of objects, and of objects in arrays, down to ``depth`` levels below the top.

    Names are paths such as ``steps[].title`` and ``owner.team``.
    """
    level, out = fields_of(files).select("file_no", F.explode("fields").alias("field_name", "v")), None
    for _ in range(depth):
        said = F.schema_of_variant("v")
        text = F.to_json("v")
        objects = F.when(said.startswith("OBJECT"), F.array(F.from_json(text, "map<string,variant>"))).when(said.startswith("ARRAY"), F.from_json(text, "array<map<string,variant>>"))
        mark = F.when(said.startswith("ARRAY"), "[].").otherwise(".")
        inner = level.where("v is not null").select("file_no", F.concat("field_name", mark).alias("above"), F.explode(objects).alias("member"))
        level = inner.select("file_no", "above", F.explode("member").alias("name", "v")).select("file_no", F.concat("above", "name").alias("field_name"), "v")
        out = _folded(level) if out is None else out.unionByName(_folded(level))
    return out if out is not None else file_schemas(files.limit(0))


def file_order(files: DataFrame) -> DataFrame:
    """``file_no, prev_no``: each file with the one exported just before it in its feed; ties go by number."""
    heads = files.where("file_no is not null").groupBy("feed", "file_no").agg(F.min("exported_at").alias("exported_at"))
    return heads.select("file_no", F.lag("file_no").over(Window.partitionBy("feed").orderBy("exported_at", "file_no")).alias("prev_no"))


def _compared(order: DataFrame, schemas: DataFrame) -> DataFrame:
    """``file_no, field_name, drift`` (removed, added or retyped) of each file against the one before it.

    Every schema is put out twice, as a file's own and as the one before of the file that
    follows it; the two meet in one aggregate.
    """
    follows = order.where("prev_no is not null")
    own = schemas.join(follows.select("file_no"), "file_no").select("file_no", "field_name", F.lit(None).cast("int").alias("old_bits"), F.col("bits").alias("new_bits"))
    old = schemas.join(follows.select(F.col("prev_no").alias("file_no"), F.col("file_no").alias("step")), "file_no").select(F.col("step").alias("file_no"), "field_name", F.col("bits").alias("old_bits"), F.lit(None).cast("int").alias("new_bits"))
    both = own.unionByName(old).groupBy("file_no", "field_name").agg(_json_type(F.max("old_bits")).alias("old_bits"), _json_type(F.max("new_bits")).alias("new_bits"))
    empty, old_bits, new_bits = TYPE_BITS["array<empty>"], F.col("old_bits"), F.col("new_bits")
    same_array = ((old_bits == empty) & (new_bits.bitwiseAND(ARRAYS) > 0)) | ((new_bits == empty) & (old_bits.bitwiseAND(ARRAYS) > 0))
    drift = F.when(new_bits.isNull(), "removed").when(old_bits.isNull(), "added").when((old_bits != new_bits) & ~same_array, "retyped")
    return both.select("file_no", "field_name", drift.alias("drift")).where("drift is not null")


def nested_changes(files: DataFrame, depth: int = 2) -> DataFrame:
    """``file_no, field_name, drift`` of members of objects and of objects in arrays, by their paths."""
    return _compared(stash(file_order(files)), nested_schemas(files, depth))


def schema_changes(files: DataFrame, key: str = "id") -> DataFrame:
    """``file_no, field_name, drift, new_name`` for each change of a file against the one before it.

    ``drift`` is renamed, removed, added or retyped. A rename pairs a gone field with a
    new one if they hold the same value in more than half of the processes (by the
    member ``key``) in which both are non-null; all such pairs are reported. Values are
    compared whole, by a 128 bit digest of their JSON. Broken and null JSON counts as a
    record without fields; repeated rows count once. If a process is in a file more than
    once with different values, the greatest digest counts.

    A feed's schemas are small, one row per file and field, whatever the number of its
    records: rows are folded before the first shuffle, so a feed or file that holds a
    third of all rows is no single task's work.
    """
    order = stash(file_order(files))
    both = stash(_compared(order, file_schemas(files)))
    moved = both.where("drift != 'retyped'").groupBy("file_no").agg(
        F.collect_set(F.when(F.col("drift") == "removed", F.col("field_name"))).alias("gone"), F.collect_set(F.when(F.col("drift") == "added", F.col("field_name"))).alias("fresh")
    ).where("size(gone) > 0 and size(fresh) > 0")
    wanted = moved.join(order, "file_no")
    ask = stash(
        wanted.select("file_no", F.col("file_no").alias("step"), F.col("fresh").alias("names"), F.lit(False).alias("old")).unionByName(
            wanted.select(F.col("prev_no").alias("file_no"), F.col("file_no").alias("step"), F.col("gone").alias("names"), F.lit(True).alias("old"))
        )
    )
    said = (
        fields_of(files.select("file_no", "raw_json"))
        .join(ask, "file_no")
        .select("step", "old", F.try_variant_get(F.try_element_at("fields", F.lit(key)), "$", "string").alias("process"), F.explode(F.map_filter("fields", lambda k, _: F.array_contains(F.col("names"), k))).alias("field_name", "v"))
        .where("process is not null")
        .where(type_bit(F.col("v")) > 0)
        .groupBy("step", "old", "process", "field_name")
        .agg(F.max(F.md5(F.to_json("v"))).alias("digest"))
    )
    said = stash(said)
    olds = said.where("old").select("step", "process", F.col("field_name").alias("old_name"), F.col("digest").alias("old_digest"))
    news = said.where("not old").select("step", "process", F.col("field_name").alias("new_name"), F.col("digest").alias("new_digest"))
    renamed = stash(
        olds.join(news, ["step", "process"])
        .groupBy("step", "old_name", "new_name")
        .agg(F.count("*").alias("n"), F.count_if(F.col("old_digest") == F.col("new_digest")).alias("same"))
        .where("2 * same > n")
        .select(F.col("step").alias("file_no"), F.col("old_name").alias("field_name"), F.lit("renamed").alias("drift"), "new_name")
    )
    used = renamed.select("file_no", "field_name", F.lit("removed").alias("drift")).unionByName(renamed.select("file_no", F.col("new_name").alias("field_name"), F.lit("added").alias("drift"))).distinct()
    plain = both.join(used, ["file_no", "field_name", "drift"], "left_anti").withColumn("new_name", F.lit(""))
    return plain.unionByName(renamed)


def union_schema(files: DataFrame) -> DataFrame:
    """``field_name, union_type, n_files``: the union of all file schemas."""
    return file_schemas(files).groupBy("field_name").agg(settle(F.bit_or("bits")).alias("bits"), F.count("*").alias("n_files")).select("field_name", promoted_name(F.col("bits")).alias("union_type"), "n_files")


#: Columns the unified table has at most; the fields of fewer files stay together in the map ``more_fields``.
MAX_COLUMNS = 1000


def unified_records(files: DataFrame, key: str = "id", max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All records in one table: ``file_no, feed, exported_at, process_id`` and one column per field.

    Columns have their field's type in the union schema: whole numbers, doubles,
    booleans and arrays of strings are typed, everything else is text, structures as
    JSON, so no value loses a digit. Names that differ in letter case only share the
    column of the lower-case name, which is text where their types differ. The names of
    at most ``max_columns`` columns come to the driver, those in most files first; the
    fields of all others are in ``more_fields``, a map of their JSON, which is there only
    if it is needed. Records stay where they are. Repeated rows come out once.
    """
    union = stash(union_schema(files))
    by_column = union.groupBy(F.lower("field_name").alias("column")).agg(F.max("n_files").alias("n"), F.sort_array(F.collect_list(F.struct("field_name", "union_type"))).alias("names")).where(F.col("column") != key.lower())
    chosen = sorted(by_column.orderBy(F.desc("n"), "column").limit(max_columns).collect(), key=lambda r: r["column"])
    typed, columns = ("bigint", "double", "boolean", "array<string>"), []
    for row in chosen:
        kinds = {n["union_type"] for n in row["names"]}
        target = kind if len(kinds) == 1 and (kind := next(iter(kinds))) in typed else "string"
        each = [F.try_variant_get(F.try_element_at("fields", F.lit(n["field_name"])), "$", target) for n in row["names"]]
        columns.append(F.coalesce(*each).alias(f"field_{row['column']}"))
    if by_column.count() > len(chosen):
        shown = F.array(*[F.lit(r["column"]) for r in chosen], F.lit(key.lower()))
        columns.append(F.transform_values(F.map_filter("fields", lambda k, _: ~F.array_contains(shown, F.lower(k))), lambda _, v: F.to_json(v)).alias("more_fields"))
    return fields_of(files.distinct()).select("file_no", "feed", "exported_at", F.try_variant_get(F.try_element_at("fields", F.lit(key)), "$", "string").alias("process_id"), *columns)
