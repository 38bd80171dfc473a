"""Compression-based complexity: the length of a raw deflate stream."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_deflater(level: int = 9):
    return zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)


def raw_deflate_length(data: bytes, level: int = 9) -> int:
    packer = raw_deflater(level)
    return len(packer.compress(data)) + len(packer.flush())


def kolmogorov(data: Column, level: int = 9) -> Column:
    """Estimated complexity of a binary column, in bytes; null stays null. Spark has no deflate, so
    batches go through Arrow."""

    @F.pandas_udf("long")
    def measured(values):
        return values.map(lambda b: None if b is None else raw_deflate_length(b, level)).astype("Int64")

    return measured(data)
