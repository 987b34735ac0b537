"""Vector expressions and the float32 container codec."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 if either vector is zero."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


@F.pandas_udf(T.BinaryType())
def pack_float32(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes of a vector."""
    import numpy as np

    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_float32(blob: pd.Series) -> pd.Series:
    """A vector from its bytes; a length that is no multiple of four is an error."""
    import numpy as np

    def one(b):
        if b is None:
            return None
        if len(b) % 4:
            raise ValueError(f"embedding blob of {len(b)} bytes")
        return np.frombuffer(b, "<f4")

    return blob.map(one)
