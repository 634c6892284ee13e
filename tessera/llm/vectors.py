"""What the operators on embeddings share: valid vectors, and packing them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Not null, not empty, all components present and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: Iterable) -> np.ndarray:
    """Equally long vectors as the rows of a double matrix."""
    return np.array([np.asarray(v, np.float64) for v in vectors])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def in_order(rows: np.ndarray) -> np.ndarray:
    """Rows in an order of their own, so that a fit does not depend on how they arrived."""
    return rows[np.lexsort(rows.T[::-1])]


def unpack(packed: Sequence[bytes], packed_as: str = "<f8") -> np.ndarray:
    """Rows packed as little-endian floating-point numbers, as doubles."""
    joined = b"".join(packed)
    return np.frombuffer(joined, packed_as).reshape(len(packed), -1).astype(np.float64, copy=False)
