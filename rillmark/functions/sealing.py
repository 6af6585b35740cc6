"""Authenticated encryption with versioned keys: what was sealed under an older key stays readable while the ring holds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(ring: dict[int, bytes], version: Column) -> Column:
    """The ring's key of a version; null for one that it doesn't hold."""
    key = F.lit(None).cast("binary")
    for v, k in ring.items():
        key = F.when(version == v, F.lit(k)).otherwise(key)
    return key


def seal(plain: Column, ring: dict[int, bytes], nonce: Column, aad: Column, version: Column | None = None) -> Column:
    """(key_version, ciphertext) under the given version, else the newest; the ciphertext begins with the 12 bytes of its nonce."""
    version = F.lit(max(ring)) if version is None else version
    return F.struct(version.alias("key_version"), F.aes_encrypt(plain, key_of(ring, version), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad).alias("ciphertext"))


def unseal(sealed: Column, ring: dict[int, bytes], aad: Column) -> Column:
    """The plain bytes; null where the ring lacks the version, or the ciphertext or ``aad`` isn't what was sealed."""
    return F.try_aes_decrypt(sealed["ciphertext"], key_of(ring, sealed["key_version"]), F.lit("GCM"), F.lit("DEFAULT"), aad)
