"""Small helpers the operators of this folder share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) whatever else the table holds; ids widen to long, null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> F.Column:
    """All columns of a row as one struct, so that columns made beside it cannot clash with the table's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def slices(batches, rows: int = 200):
    """Arrow batches in pieces of a bounded number of rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def filesystem(path: str):
    """(file system, path in it) for a path of any scheme that pyarrow knows; ``s3a`` and ``s3n`` are ``s3``."""
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    if sep and scheme in ("s3a", "s3n"):
        path = "s3://" + rest
    elif path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SubstringHash:
    """64-bit hashes of any substrings of a byte string, from one running sum.

    The hash of bytes s..e is sum(T[c] * r**-(j - s)) modulo 2**64, finalised: the running sum of T[c] * r**-j over
    all positions j gives it for every (s, e) by one subtraction and one product with r**s.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.root = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.back = pow(self.root, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.root, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.back, k, 1 << 64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.up[start])
