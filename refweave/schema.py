"""Schemas of the stored tables and of the providers' input tables, and kinds of symbols."""

from __future__ import annotations

from pyspark.sql import types as T

CODE_FILES = T.StructType([T.StructField("relative_path", T.StringType(), False), T.StructField("updated_at", T.TimestampNTZType())])
SYMBOLS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("parent_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("kind", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("update_id", T.StringType()), T.StructField("pos_x", T.FloatType()), T.StructField("pos_y", T.FloatType()),
])
SYMBOL_REFERENCES = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("from_symbol_id", T.StringType()), T.StructField("to_symbol_id", T.StringType()),
    T.StructField("from_path", T.StringType()), T.StructField("to_path", T.StringType()), T.StructField("reference_type", T.StringType()), T.StructField("line_number", T.IntegerType()),
])
TABLES = {"code_files": CODE_FILES, "symbols": SYMBOLS, "symbol_references": SYMBOL_REFERENCES}

PROVIDER_SYMBOLS = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("symbol_key", T.StringType(), False), T.StructField("parent_key", T.StringType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("kind", T.IntegerType()),
    *[T.StructField(f"{at}_{unit}", T.IntegerType()) for at in ("start", "end", "sel") for unit in ("line", "char")],
])
PROVIDER_LOCATIONS = T.StructType([
    T.StructField("decl_path", T.StringType(), False), T.StructField("decl_key", T.StringType()), T.StructField("target_path", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("char", T.IntegerType()),
])

FILE = 0
# Names of the kinds of symbols by number (fixed values).
KIND_NAMES = [
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable",
    "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
]
