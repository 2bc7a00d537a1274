"""The 64-bit command hash of build logs.

rapidhash is a public algorithm; it needs the 128-bit product of two 64-bit
numbers, which Spark's expressions don't have, so it runs in Arrow batches.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: the seed and the three secrets.
SEED = 0xBDD89AA982704029
SECRETS = (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3)
_M = (1 << 64) - 1


def _fold(a: int, b: int) -> int:
    p = a * b
    return (p ^ (p >> 64)) & _M


def rapid64(key: bytes) -> int:
    """Hash of some bytes as an unsigned number."""
    s0, s1, s2 = SECRETS
    n = len(key)
    h = SEED ^ _fold(SEED ^ s0, s1) ^ n
    if n > 16:
        head = key
        if n > 48:
            # Three lanes over blocks of 48 bytes; the rest of at most 48 goes on below.
            lanes = [h, h, h]
            blocks = n // 48
            words = struct.unpack_from(f"<{6 * blocks}Q", key)
            for k in range(0, 6 * blocks, 6):
                lanes = [_fold(words[k + 2 * i] ^ SECRETS[i], words[k + 2 * i + 1] ^ lanes[i]) for i in range(3)]
            h = lanes[0] ^ lanes[1] ^ lanes[2]
            head = key[48 * blocks :]
        left = len(head)
        if left > 16:
            x, y = struct.unpack_from("<2Q", head)
            h = _fold(x ^ s2, y ^ h ^ s1)
            if left > 32:
                x, y = struct.unpack_from("<2Q", head, 16)
                h = _fold(x ^ s2, y ^ h)
        a, b = struct.unpack("<2Q", key[-16:])
    elif n >= 4:
        shift = 4 if n >= 8 else 0
        word = lambda at: struct.unpack_from("<I", key, at)[0]
        a = word(0) << 32 | word(n - 4)
        b = word(shift) << 32 | word(n - 4 - shift)
    else:
        a = key[0] << 56 | key[n // 2] << 32 | key[n - 1] if n else 0
        b = 0
    p = (a ^ s1) * (b ^ h)
    return _fold((p & _M) ^ s0 ^ n, (p >> 64) ^ s1)


def rapidhash(text: Column) -> Column:
    """The hash as lower-case hexadecimal digits without leading zeros, as logs write it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f"{rapid64(x.encode()):x}")

    return run(text)


def hash_input(command: Column, rspfile_content: Column) -> Column:
    """What is hashed for a build statement: the command and, if there is one, what its response file holds."""
    return F.when(F.coalesce(rspfile_content, F.lit("")) == "", command).otherwise(F.concat(command, F.lit(";rspfile="), rspfile_content))


def command_hash(command: Column, rspfile_content: Column) -> Column:
    return rapidhash(hash_input(command, rspfile_content))
