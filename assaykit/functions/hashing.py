"""Deterministic hash expressions used wherever rows are sampled or ordered at random."""

import hashlib

from pyspark.sql import functions as F

# 13 hexadecimal digits fit a double exactly.
_HEX_DIGITS = 13
_HEX_SPAN = float(16**_HEX_DIGITS)


def stable_uniform(key, seed):
    """Uniform in [0, 1) that depends on ``seed`` and the text of ``key`` only."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    digits = F.substring(F.md5(text), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_HEX_SPAN)


def names_in_hash_order(names, seed):
    """Column names ordered by the md5 of ``seed:name``; a schema operation."""
    return sorted(names, key=lambda name: (hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), name))


def hash_signs(width, planes, seed):
    """``planes`` vectors of ``width`` signs, sign ``j`` of plane ``i`` from md5 of ``seed:i:j``.

    A first hexadecimal digit of 8 or more gives +1, else -1.
    """
    def sign(plane, position):
        digest = hashlib.md5(f"{seed}:{plane}:{position}".encode()).hexdigest()
        return 1.0 if int(digest[0], 16) >= 8 else -1.0

    return [[sign(i, j) for j in range(width)] for i in range(planes)]
