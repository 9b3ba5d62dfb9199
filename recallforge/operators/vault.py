"""Vault: values encrypted with AES-256-GCM under a data key, which a passphrase's key wraps, with queryable metadata."""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors, text

# Limits and cost of the key derivation.
MAX_VALUE = 64 * 1024
SCRYPT = {"n": 1 << 15, "r": 8, "p": 1, "maxmem": 64 << 20}


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key from a passphrase, on the driver (memory-hard; the standard library's scrypt)."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, dklen=32, **SCRYPT)


def new_salt() -> bytes:
    return os.urandom(16)


def wrap_key(spark: SparkSession, data_key: bytes, key: bytes) -> str:
    """A vault's data key, encrypted under the key of a passphrase."""
    wrapped = F.aes_encrypt(F.lit(data_key), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))
    return spark.range(1).select(F.base64(wrapped)).first()[0]


def unwrap_key(spark: SparkSession, wrapped: str, key: bytes) -> bytes:
    """The data key; a wrong passphrase raises ValueError."""
    data_key = spark.range(1).select(F.try_aes_decrypt(F.unbase64(F.lit(wrapped)), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))).first()[0]
    if data_key is None:
        raise ValueError("the vault's key can't be unwrapped with this passphrase")
    return bytes(data_key)


def _bound(vault: Column, name: Column) -> Column:
    """What a value is bound to: it can't be moved to another name."""
    return F.concat_ws("/", vault, name)


def seal(secrets: DataFrame, key: bytes) -> DataFrame:
    """(vault, name, value) with the value encrypted; values over 64 KB raise when read."""
    value = F.when(F.octet_length("value") > MAX_VALUE, F.raise_error(F.lit("value exceeds 64 KB"))).otherwise(F.col("value"))
    sealed = F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), _bound(F.col("vault"), F.col("name")).cast("binary"))
    return secrets.withColumn("sealed", F.base64(sealed)).withColumn("sensitive_name", detectors.sensitive_name(F.col("name"))).drop("value")


def unseal(sealed: DataFrame, key: bytes) -> DataFrame:
    """(vault, name, value); a wrong key or a moved value gives null."""
    value = F.try_aes_decrypt(F.unbase64("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("vault"), F.col("name")).cast("binary"))
    return sealed.withColumn("value", value.cast("string")).drop("sealed")


def rotate(sealed: DataFrame, old: bytes, new: bytes) -> DataFrame:
    return seal(unseal(sealed, old), new)


def resolve(refs: DataFrame, sealed: DataFrame) -> DataFrame:
    """References (ref) with the vault and name they mean and whether there is such a value."""
    vault, name = text.vault_ref(F.col("ref"))
    known = sealed.select("vault", "name").distinct().withColumn("found", F.lit(True))
    return refs.withColumn("vault", vault).withColumn("name", name).join(known, ["vault", "name"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def metadata(sealed: DataFrame) -> DataFrame:
    """What may be listed: never values."""
    return sealed.drop("sealed")


def put(sealed: DataFrame, new: DataFrame, key: bytes, now: Column) -> DataFrame:
    """The vault after new secrets (vault, name, value, ...): they replace those of their names, whose time of creation they keep."""
    fresh = seal(new, key).withColumns({"created": now, "updated": now})
    if "created" not in sealed.columns:
        sealed = sealed.withColumns({"created": now, "updated": now})
    born = sealed.select("vault", "name", F.col("created").alias("_created"))
    fresh = fresh.join(born, ["vault", "name"], "left").withColumn("created", F.coalesce("_created", "created")).drop("_created")
    return sealed.join(new.select("vault", "name"), ["vault", "name"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove(sealed: DataFrame, names: DataFrame) -> DataFrame:
    """The vault without the names (vault, name)."""
    return sealed.join(names.select("vault", "name").distinct(), ["vault", "name"], "left_anti")


def environment(sealed: DataFrame, key: bytes, mapping: dict[str, str], vault: str) -> dict[str, str]:
    """Variables with the values of the secrets that ``mapping`` names for them, on the driver; a missing one raises KeyError."""
    rows = unseal(sealed.filter((F.col("vault") == vault) & F.col("name").isin(*set(mapping.values()))), key).select("name", "value").collect()
    values = {r["name"]: r["value"] for r in rows if r["value"] is not None}
    return {variable: values[name] for variable, name in mapping.items()}


def run(sealed: DataFrame, key: bytes, mapping: dict[str, str], vault: str, command: list[str], timeout: float = 60) -> tuple[int, str]:
    """(exit code, output) of a command with secrets in its environment; their values are taken out of the output."""
    env = environment(sealed, key, mapping, vault)
    done = subprocess.run(command, env={**os.environ, **env}, capture_output=True, text=True, timeout=timeout, check=False)
    output = done.stdout + done.stderr
    for value in sorted(filter(None, env.values()), key=len, reverse=True):
        output = output.replace(value, "[REDACTED]")
    return done.returncode, output
