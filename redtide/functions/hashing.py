"""A hash of plain integer arithmetic, so every engine computes the same pseudo-random order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2**31 - 1, prime: every product below stays inside a signed 64-bit integer


def portable_hash(id_col: Column | str, k: Column | int = 0) -> Column:
    """Uniform BIGINT in [0, 2**31 - 1) from a non-negative id and a stream number `k`.

    The middle step multiplies two different residues, so that changing `k` reshuffles the
    order instead of rotating it.
    """
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    stream = F.lit(k).cast("bigint") if isinstance(k, int) else k.cast("bigint")
    mixed = (ident.cast("bigint") % MODULUS * 48271 + stream * 104729 + 42) % MODULUS
    crossed = ((mixed % 46337) * (mixed % 46339) + mixed) % MODULUS
    return crossed * 69621 % MODULUS


def portable_hashes(ids: np.ndarray, k: int = 0) -> np.ndarray:
    """`portable_hash` of an array, for tasks."""
    mixed = (ids.astype(np.int64) % MODULUS * 48271 + k * 104729 + 42) % MODULUS
    crossed = ((mixed % 46337) * (mixed % 46339) + mixed) % MODULUS
    return crossed * 69621 % MODULUS
