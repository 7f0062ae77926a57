"""Key derivation and value encryption for reversible tokens."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32


def derive_key(password: str, salt: bytes | str = b"salt") -> bytes:
    """A 256-bit key from a password (scrypt), computed once where the job is planned."""
    raw = salt.encode() if isinstance(salt, str) else salt
    return hashlib.scrypt(password.encode(), salt=raw, n=1 << 14, r=8, p=1, dklen=KEY_BYTES)


def _key(key: bytes) -> Column:
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must have {KEY_BYTES} bytes")
    return F.lit(bytearray(key))


def encrypt_value(value: Column, key: bytes) -> Column:
    """AES-256-GCM with a random IV in front; every call gives another ciphertext."""
    return F.aes_encrypt(F.encode(value, "UTF-8"), _key(key), F.lit("GCM"))


def decrypt_value(ciphertext: Column, key: bytes) -> Column:
    """The plain text, or NULL where key, tag or input do not fit."""
    return F.decode(F.try_aes_decrypt(ciphertext, _key(key), F.lit("GCM")), "UTF-8")
