"""Whole definitions out of JSON and back: typed columns for every known key, nested arrays and maps among them, and a
map of VARIANT for the keys that are not known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborql.operators.tree import CHILDREN

_LOCALIZED = "map<string,string>"
_PIECES = "array<struct<`key.bb.name_piece_is_name`:boolean,`key.bb.name_piece_text`:string>>"
_DOCS = (f"struct<`key.bb.abstract`:{_LOCALIZED},`key.bb.discussion`:{_LOCALIZED},`key.bb.throws`:{_LOCALIZED},`key.bb.returns`:{_LOCALIZED},"
         f"`key.bb.parameters`:array<struct<`key.bb.param_name`:string,`key.bb.param_desc`:{_LOCALIZED}>>,`key.bb.doc_source`:string>")

#: Column, key and type of what a definition may hold.
FIELDS = [
    ("name", "key.name", "string"), ("kind", "key.kind", "string"), ("usr", "key.usr", "string"), ("typename", "key.typename", "string"),
    ("typeusr", "key.typeusr", "string"), ("accessibility", "key.accessibility", "string"), ("modulename", "key.modulename", "string"),
    ("doc_comment", "key.doc.comment", "string"), ("doc_xml", "key.doc.full_as_xml", "string"), ("doc_file", "key.doc.file", "string"),
    ("doc_line", "key.doc.line", "bigint"), ("doc_column", "key.doc.column", "bigint"), ("filepath", "key.filepath", "string"),
    ("offset", "key.offset", "bigint"), ("length", "key.length", "bigint"), ("scope_start", "key.parsed_scope.start", "bigint"), ("scope_end", "key.parsed_scope.end", "bigint"),
    ("declaration", "key.parsed_declaration", "string"), ("annotated_decl", "key.annotated_decl", "string"), ("fully_annotated_decl", "key.fully_annotated_decl", "string"),
    ("diagnostic_stage", "key.diagnostic_stage", "string"), ("swift_name", "key.swift_name", "string"), ("swift_decl", "key.swift_declaration", "string"),
    ("always_deprecated", "key.always_deprecated", "boolean"), ("always_unavailable", "key.always_unavailable", "boolean"),
    ("deprecation_message", "key.deprecation_message", "string"), ("unavailable_message", "key.unavailable_message", "string"),
    ("attributes", "key.attributes", "array<struct<`key.attribute`:string,`key.offset`:bigint,`key.length`:bigint>>"),
    ("inherited", "key.inheritedtypes", "array<struct<`key.name`:string>>"), ("overrides", "key.overrides", "array<struct<`key.usr`:string>>"),
    ("swift_declaration", "key.bb.swift_declaration", "string"), ("objc_declaration", "key.bb.objc_declaration", "string"),
    ("swift_deprecation", "key.bb.swift_deprecation_messages", _LOCALIZED), ("swift_deprecated_everywhere", "key.bb.swift_deprecated_everywhere", "boolean"),
    ("swift_unavailability", "key.bb.swift_unavailable_messages", _LOCALIZED), ("objc_deprecation", "key.bb.objc_deprecation_messages", _LOCALIZED),
    ("objc_unavailability", "key.bb.objc_unavailable_messages", _LOCALIZED), ("availability", "key.bb.availabilities", "array<struct<`key.bb.availability`:string>>"),
    ("type_module_name", "key.bb.type_module_name", "string"), ("inherited_types", "key.bb.inherited_types", "array<struct<`key.bb.type_name`:string>>"),
    ("is_override", "key.bb.is_override", "boolean"), ("is_spi", "key.bb.is_spi", "boolean"), ("swift_pieces", "key.bb.swift_name_pieces", _PIECES),
    ("objc_pieces", "key.bb.objc_name_pieces", _PIECES), ("docs", "key.bb.documentation", _DOCS),
]


def definitions(rows: DataFrame, value: str = "v") -> DataFrame:
    """PRJ1: rows(.., v VARIANT) with a typed column for each of FIELDS in place of v, and rest, a map of VARIANT. A key
    whose value is of another type is null in its column and stays in rest, as does any key that is not known; children
    are rows of their own (PRJ4)."""
    keep = [c for c in rows.columns if c != value]
    typed = [F.try_variant_get(value, f'$["{key}"]', kind).alias(c) for c, key, kind in FIELDS]
    d = rows.select(*keep, *typed, F.try_variant_get(value, "$", "map<string,variant>").alias("rest"))
    read = F.array_append(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(key)) for c, key, _ in FIELDS])), F.lit(CHILDREN))
    return d.withColumn("__read", read).withColumn("rest", F.map_filter("rest", lambda k, _: ~F.array_contains(F.col("__read"), k))).drop("__read")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """JS2: rows of ``definitions`` with the JSON object that they were read from, keys in the order of FIELDS and then the
    rest. Nulls are left out, and so are empty arrays and maps."""
    fields = []
    for c, key, kind in FIELDS:
        if c in df.columns:
            v = F.col(c)
            fields.append((F.when(F.size(v) > 0, v) if kind.startswith(("array", "map")) else v).alias(key))
    own = F.to_json(F.struct(*fields))
    if "rest" not in df.columns:
        return df.withColumn(name, own)
    rest = F.coalesce(F.to_json("rest"), F.lit("{}"))
    inner = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
    both = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner(own), F.lit("")), F.nullif(inner(rest), F.lit(""))), F.lit("}"))
    return df.withColumn(name, both)


def row_type() -> StructType:
    """The columns of FIELDS as a schema."""
    return StructType.fromDDL(", ".join(f"`{c}` {kind}" for c, _, kind in FIELDS))
