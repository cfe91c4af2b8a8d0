"""Vector expressions: cosine similarity and the stored forms of a vector.

``cosine`` is one column expression and stays in the JVM. ``cosine_batch``
computes the same number over Arrow batches and is the cheaper form for long
vectors. Both return NULL for unequal lengths and 0 where a norm is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Similarities are kept to this many decimals so that two vectors that are
#: equally close cannot be told apart by the order of floating-point additions.
SIMILARITY_DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), F.round(value, SIMILARITY_DIGITS))


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length ``dim`` as a float64 matrix, and the mask of rows that have that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = lengths == dim
    kept = column if fits.all() else column.filter(pa.array(fits))
    flat = kept.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, dim), fits


def safe_cosine(dots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.zeros_like(dots, dtype=np.float64)
    np.divide(dots, scale, out=out, where=scale != 0)
    return np.round(out, SIMILARITY_DIGITS)


def cosine_to(query: Sequence[float]):
    """Arrow function: cosine of each vector of a column with one fixed query vector.

    Marked non-deterministic so that Spark evaluates it once per row, where it stands.
    """
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.sqrt(q @ q))

    @F.arrow_udf(T.DoubleType())
    def run(v: pa.Array) -> pa.Array:
        m, fits = as_matrix(v, len(q))
        out = np.zeros(len(fits))
        out[fits] = safe_cosine(m @ q, np.sqrt(np.einsum("ij,ij->i", m, m)) * q_norm)
        return pa.array(out, mask=~fits)

    return run.asNondeterministic()


@F.arrow_udf(T.DoubleType())
def cosine_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise cosine of two vector columns; lengths may differ from row to row."""
    la = a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    lb = b.value_lengths().fill_null(-2).to_numpy(zero_copy_only=False)
    out = np.zeros(len(la))
    known = la == lb
    for dim in np.unique(la[known]):
        rows = known & (la == dim)
        pick = pa.array(rows)
        ma, _ = as_matrix(a.filter(pick), int(dim))
        mb, _ = as_matrix(b.filter(pick), int(dim))
        scale = np.sqrt(np.einsum("ij,ij->i", ma, ma)) * np.sqrt(np.einsum("ij,ij->i", mb, mb))
        out[rows] = safe_cosine(np.einsum("ij,ij->i", ma, mb), scale)
    return pa.array(out, mask=~known)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to a list; trailing bytes short of four are an error.

    All vectors of a batch are one view of the batch's bytes.
    """
    sizes = pc.fill_null(pc.binary_length(blob), 0).to_numpy(zero_copy_only=False)
    if (sizes % 4).any():
        raise ValueError("a stored vector must hold four bytes per number")
    ends = np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32)
    data = b"".join(b for b in _pieces(blob))
    missing = pa.array(np.append(blob.is_null().to_numpy(zero_copy_only=False), False))
    offsets = pc.if_else(missing, pa.scalar(None, pa.int32()), pa.array(ends))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(data, dtype="<f4")))


def _pieces(blob: pa.Array):
    """The bytes of the values of a binary array, in runs that lie together in its buffer."""
    kept = blob.drop_null()
    if not len(kept):
        return
    offset_type = np.int64 if pa.types.is_large_binary(kept.type) else np.int32
    _, offsets, data = kept.buffers()
    at = np.frombuffer(offsets, dtype=offset_type)[kept.offset : kept.offset + len(kept) + 1]
    if data is not None:
        yield memoryview(data)[int(at[0]) : int(at[-1])]


@F.arrow_udf(T.BinaryType())
def encode_f32(vec: pa.Array) -> pa.Array:
    """A list of numbers to little-endian float32 bytes; a missing number becomes NaN."""
    flat = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False), dtype="<f4")
    sizes = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
    missing = vec.is_null().to_numpy(zero_copy_only=False)
    mask = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(vec), [mask, pa.py_buffer(ends), pa.py_buffer(flat)])


def parse_vector_text(col: Column) -> Column:
    """``[a,b,...]`` text to a list of doubles."""
    return F.from_json(col, T.ArrayType(T.DoubleType()))


def format_vector_text(col: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: x.cast("string")), ","), F.lit("]"))
