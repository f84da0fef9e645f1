"""Bit-level column expressions: floats as unsigned bit patterns, byte planes, sign / exponent / mantissa fields.

A bit pattern is a BIGINT ``u``; 64-bit ones are two's complement and are ordered by ``unsigned_key``.
Only the reinterpretation of floats needs a kernel (an Arrow view, no copy of meaning); the rest is
plain SQL arithmetic that Spark compiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK32 = 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def _f64(x: pd.Series) -> pd.Series:
    return pd.Series(np.ascontiguousarray(x.to_numpy(np.float64)).view(np.int64))


@F.pandas_udf(T.LongType())
def _f32(x: pd.Series) -> pd.Series:
    return pd.Series(np.ascontiguousarray(x.to_numpy(np.float32)).view(np.uint32).astype(np.int64))


def _lists(x: pa.Array, make) -> pa.Array:
    """A list array whose flat values went through ``make``; lists and elements that are null stay so."""
    values = x.values
    flat = make(values.fill_null(0) if values.null_count else values)
    return pa.ListArray.from_arrays(x.offsets.cast(pa.int32()), pa.array(flat, pa.int64(), mask=np.asarray(values.is_null()) if values.null_count else None), mask=x.is_null() if x.null_count else None)


def _f32_flat(v: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(v.to_numpy(zero_copy_only=False), np.float32).view(np.uint32).astype(np.int64)


def _f64_flat(v: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(v.to_numpy(zero_copy_only=False), np.float64).view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _f32_array(x: pa.Array) -> pa.Array:
    return _lists(x, _f32_flat)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _f64_array(x: pa.Array) -> pa.Array:
    return _lists(x, _f64_flat)


def _bytes_of(x: pa.Array, kind: str) -> pa.Array:
    """Each list of patterns as little-endian bytes: one buffer, cut at the lists' offsets."""
    width = np.dtype(kind).itemsize
    off = x.offsets.to_numpy().astype(np.int64)
    flat = x.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(kind)
    off = ((off - off[0]) * width).astype(np.int64)
    valid = None if not x.null_count else pa.array(np.asarray(x.is_valid())).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(x), [valid, pa.py_buffer(off), pa.py_buffer(flat)]).cast(pa.binary())


def _patterns_of(x: pa.Array, kind: str) -> pa.Array:
    """The inverse of ``_bytes_of``; bytes that fill no element are left out."""
    width = np.dtype(kind).itemsize
    rows = [np.frombuffer(b.as_buffer(), kind, len(b.as_buffer()) // width) if b.is_valid else np.zeros(0, kind) for b in x]
    off = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int64()), mask=x.is_null() if x.null_count else None)


@F.arrow_udf(T.BinaryType())
def _pack_u32(x: pa.Array) -> pa.Array:
    return _bytes_of(x, "<u4")


@F.arrow_udf(T.BinaryType())
def _pack_i64(x: pa.Array) -> pa.Array:
    return _bytes_of(x, "<i8")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _unpack_u32(x: pa.Array) -> pa.Array:
    return _patterns_of(x, "<u4")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _unpack_i64(x: pa.Array) -> pa.Array:
    return _patterns_of(x, "<i8")


def packed_patterns(us: Column, width: int) -> Column:
    """An array of patterns of 4 or 8 bytes as little-endian bytes."""
    return {4: _pack_u32, 8: _pack_i64}[width](us)


def unpacked_patterns(raw: Column, width: int) -> Column:
    """The patterns of 4 or 8 bytes of a binary column."""
    return {4: _unpack_u32, 8: _unpack_i64}[width](raw)


def f64_bits(c: Column) -> Column:
    """The pattern of a double; null stays null (pandas would make it NaN)."""
    return F.when(c.isNotNull(), _f64(c))


def f32_bits(c: Column) -> Column:
    return F.when(c.isNotNull(), _f32(c))


def f32_array_bits(c: Column) -> Column:
    return _f32_array(c)


def f64_array_bits(c: Column) -> Column:
    return _f64_array(c)


def unsigned_key(u: Column) -> Column:
    """Orders 64-bit patterns as unsigned numbers."""
    return u.bitwiseXOR(F.lit(-(1 << 63)))


def byte_plane(u: Column, j: int) -> Column:
    """Byte j of a pattern, counted from the lowest."""
    return F.shiftrightunsigned(u, 8 * j).bitwiseAND(F.lit(255))


def byte_planes(u: Column, width: int) -> Column:
    """All byte planes of a pattern as an array."""
    return F.array(*(byte_plane(u, j) for j in range(width)))


def join_bytes(byte: Column, plane: Column) -> Column:
    """The aggregate that rebuilds patterns from their byte planes; the bits are disjoint, so their sum is their union."""
    return F.sum(F.call_function("shiftleft", byte.cast("long"), (plane * 8).cast("int")))


@dataclass(frozen=True)
class FloatSpec:
    name: str
    total: int
    exponent: int
    mantissa: int


#: Float geometries with a field transform.
SPECS = {s.name: s for s in (FloatSpec("float32", 32, 8, 23), FloatSpec("float16", 16, 5, 10), FloatSpec("bfloat16", 16, 8, 7))}
ALIASES = {"fp32": "float32", "f32": "float32", "fp16": "float16", "f16": "float16", "half": "float16", "bf16": "bfloat16"}


def resolve_spec(dtype: str) -> FloatSpec:
    """The geometry of a float type by any of its names; KeyError for others."""
    name = dtype.lower()
    return SPECS[ALIASES.get(name, name)]


def sign(u: Column, s: FloatSpec) -> Column:
    return F.shiftrightunsigned(u, s.total - 1).bitwiseAND(F.lit(1))


def exponent(u: Column, s: FloatSpec) -> Column:
    return F.shiftrightunsigned(u, s.mantissa).bitwiseAND(F.lit((1 << s.exponent) - 1))


def mantissa(u: Column, s: FloatSpec) -> Column:
    return u.bitwiseAND(F.lit((1 << s.mantissa) - 1))


def join_fields(sign_: Column, exponent_: Column, mantissa_: Column, s: FloatSpec) -> Column:
    return F.shiftleft(sign_, s.total - 1) + F.shiftleft(exponent_, s.mantissa) + mantissa_


def bf16_truncated(u32: Column) -> Column:
    """The upper half of a float32 pattern."""
    return F.shiftrightunsigned(u32, 16).bitwiseAND(F.lit(0xFFFF))


def bf16_rounded(u32: Column) -> Column:
    """bfloat16 by rounding to nearest, ties to even."""
    odd = F.shiftrightunsigned(u32, 16).bitwiseAND(F.lit(1))
    return F.shiftrightunsigned(u32 + odd + F.lit(0x7FFF), 16).bitwiseAND(F.lit(0xFFFF))


def packed_byte(bit: Column, pos: Column) -> Column:
    """The aggregate that packs bits, element i of a group of eight at bit 7 - i."""
    return F.sum(F.call_function("shiftleft", bit.cast("long"), (F.lit(7) - F.pmod(pos, F.lit(8))).cast("int")))


def packed_low_bits(value: Column, pos: Column, bits: int) -> Column:
    """The aggregate that packs the low ``bits`` (at most 7) of eight elements into one pattern, the first one highest."""
    return F.sum(F.call_function("shiftleft", value.cast("long"), ((F.lit(7) - F.pmod(pos, F.lit(8))) * bits).cast("int")))


def level(x: Column, scale: Column) -> Column:
    """The level of symmetric quantisation to multiples of ``scale``; 0 where there is no scale."""
    return F.when(scale > 0, F.rint(x / scale).cast("long")).otherwise(F.lit(0).cast("long"))


def quantised(x: Column, scale: Column) -> Column:
    """Quantised and back."""
    return level(x, scale) * scale


def tail_length(length: Column, width: Column | int) -> Column:
    return F.pmod(length, F.lit(width) if isinstance(width, int) else width)


@dataclass(frozen=True)
class DType:
    code: str
    width: int
    transform: str  # of the default codec: opaque, byteplane or fields
    safetensors: str | None
    numpy: str | None


#: One registry for every type name; integers inside a container are opaque there.
DTYPES = [
    DType("bf16", 2, "fields", "BF16", None),
    DType("fp16", 2, "byteplane", "F16", "<f2"),
    DType("fp32", 4, "byteplane", "F32", "<f4"),
    DType("fp64", 8, "byteplane", "F64", "<f8"),
    DType("fp8_e4m3", 1, "opaque", "F8_E4M3", None),
    DType("fp8_e5m2", 1, "opaque", "F8_E5M2", None),
    DType("int16", 2, "byteplane", "I16", "<i2"),
    DType("uint16", 2, "byteplane", "U16", "<u2"),
    DType("int32", 4, "byteplane", "I32", "<i4"),
    DType("uint32", 4, "byteplane", "U32", "<u4"),
    DType("int64", 8, "byteplane", "I64", "<i8"),
    DType("uint64", 8, "byteplane", "U64", "<u8"),
    DType("int8", 1, "opaque", "I8", "|i1"),
    DType("uint8", 1, "opaque", "U8", "|u1"),
    DType("bool", 1, "opaque", "BOOL", "|b1"),
    DType("raw", 1, "opaque", None, None),
]
DTYPE_ALIASES = {"bfloat16": "bf16", "float16": "fp16", "half": "fp16", "float32": "fp32", "float": "fp32", "float64": "fp64", "double": "fp64", "u8": "uint8", "i8": "int8", "fp8": "fp8_e4m3"}
_BY_CODE = {d.code: d for d in DTYPES}
BY_SAFETENSORS = {d.safetensors: d for d in DTYPES if d.safetensors}


def dtype(name: str | None) -> DType:
    """The registry entry of a type name, in any case; None is raw bytes."""
    code = (name or "raw").lower()
    code = DTYPE_ALIASES.get(code, BY_SAFETENSORS[code.upper()].code if code.upper() in BY_SAFETENSORS else code)
    if code not in _BY_CODE:
        raise ValueError(f"unknown dtype {name!r}")
    return _BY_CODE[code]
