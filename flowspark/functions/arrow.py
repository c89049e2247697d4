"""Flows as Arrow batches: numpy columns, byte matrices and lists to arrays, unset columns included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

_KINDS = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}


def kind_of(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(kind_of(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, kind_of(f.dataType)) for f in t])
    return _KINDS[type(t)]


def schema_of(s: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, kind_of(f.dataType)) for f in s])


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return out


def binary_of(data: np.ndarray | bytes, lengths: np.ndarray) -> pa.Array:
    """Byte strings that stand one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets_of(lengths)), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])


def list_of(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets_of(lengths), pa.int32()), values)


def unset(t: pa.DataType, n: int) -> pa.Array:
    """n unset values: zeros, empty bytes, empty lists; texts are null."""
    if pa.types.is_list(t):
        return list_of(pa.array([], t.value_type), np.zeros(n, np.int32))
    if pa.types.is_binary(t):
        return binary_of(b"", np.zeros(n, np.int32))
    return pa.nulls(n, t) if pa.types.is_string(t) else pa.array(np.zeros(n, t.to_pandas_dtype()))


def column(values, t: pa.DataType, n: int) -> pa.Array:
    """None (unset), numbers, a matrix of bytes (a value a row), an array or a list of values."""
    if values is None:
        return unset(t, n)
    if isinstance(values, pa.Array):
        return values if values.type == t else values.cast(t)
    if isinstance(values, np.ndarray):
        if values.ndim == 2:
            return binary_of(values, np.full(n, values.shape[1]))
        return pa.array(values.astype(t.to_pandas_dtype()))
    return pa.array(values, t)


def batch_of(columns: Mapping, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of schema; columns that are not given are unset."""
    return pa.RecordBatch.from_arrays([column(columns.get(f.name), f.type, n) for f in schema], schema=schema)


def rows_of(rows: Sequence[Mapping], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of dictionaries."""
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
