"""Table schemas."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("size", T.LongType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("last_indexed", T.DoubleType()),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("file_path", T.StringType(), False),
    *[T.StructField(c, T.IntegerType()) for c in ("chunk_index", "total_chunks", "start_line", "end_line", "start_char", "end_char", "prev_id", "next_id")],
    *[T.StructField(c, T.StringType()) for c in ("function_name", "class_name", "symbol_type")],
    *[T.StructField(c, T.BooleanType()) for c in ("has_file_header", "is_continuation", "has_signature_context")],
])

COLLECTIONS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("dimension", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.LongType()),
])
