"""Sealing of vault rows and envelopes. Keys never become literals of a plan: they travel in closures and
reach expressions only as columns; AES runs in the JVM.

Row format: version byte 1, 12-byte IV, ciphertext, 16-byte tag; the key is HMAC(KEK, scope 0 token), which
is also the additional data, so a row that is moved or changed does not open.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, IV, TAG = 1, 12, 16
SCRYPT = {"n": 65536, "r": 8, "p": 1, "dklen": 32, "maxmem": 128 * 1024 * 1024}


def row_key(kek: bytes, scope: str, token: str) -> bytes:
    return hmac.new(kek, f"{scope}\0{token}".encode(), hashlib.sha256).digest()


def _row_keys(kek: bytes) -> Column:
    @F.pandas_udf("binary")
    def keys(scopes: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for scope, token in scopes:
            yield pd.Series([row_key(kek, s, t) for s, t in zip(scope, token)])

    return keys("scope", "token")


def _additional() -> Column:
    return F.concat_ws("\0", "scope", "token")


def seal_rows(vault: DataFrame, kek: bytes) -> DataFrame:
    """vault (scope, token, type, ...) to (scope, token, type, blob): all other columns sealed as one JSON value."""
    hidden = [c for c in vault.columns if c not in ("scope", "token", "type")]
    keyed = vault.withColumn("_key", _row_keys(kek)).withColumn("_value", F.to_json(F.struct(*hidden)))
    blob = F.concat(F.lit(bytes([VERSION])), F.aes_encrypt("_value", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _additional().cast("binary")))
    return keyed.select("scope", "token", "type", blob.alias("blob"))


def open_rows(sealed: DataFrame, kek: bytes, schema: str) -> DataFrame:
    """The reverse; a tampered or moved row fails the job."""
    keyed = sealed.withColumn("_key", _row_keys(kek))
    value = F.aes_decrypt(F.expr("substring(blob, 2)"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _additional().cast("binary")).cast("string")
    return keyed.select("scope", "token", "type", F.from_json(value, schema).alias("v")).select("scope", "token", "type", "v.*")


def _jvm():
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm


def _gcm(key: bytes, iv: bytes, data: bytes, mode: str, additional: bytes = b"") -> bytes:
    jvm = _jvm()
    cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    spec = jvm.javax.crypto.spec.SecretKeySpec(key, "AES")
    kind = jvm.javax.crypto.Cipher.ENCRYPT_MODE if mode == "seal" else jvm.javax.crypto.Cipher.DECRYPT_MODE
    cipher.init(kind, spec, jvm.javax.crypto.spec.GCMParameterSpec(TAG * 8, iv))
    if additional:
        cipher.updateAAD(additional)
    return bytes(cipher.doFinal(data))


def _wrap(kek: bytes, key: bytes, mode: str) -> bytes:
    jvm = _jvm()
    cipher = jvm.javax.crypto.Cipher.getInstance("AESWrap")
    outer = jvm.javax.crypto.spec.SecretKeySpec(kek, "AES")
    if mode == "wrap":
        cipher.init(jvm.javax.crypto.Cipher.WRAP_MODE, outer)
        return bytes(cipher.wrap(jvm.javax.crypto.spec.SecretKeySpec(key, "AES")))
    cipher.init(jvm.javax.crypto.Cipher.UNWRAP_MODE, outer)
    return bytes(cipher.unwrap(key, "AES", jvm.javax.crypto.Cipher.SECRET_KEY).getEncoded())


def encrypt_bytes(plain: bytes, kek: bytes) -> bytes:
    """An envelope: a data key per object, wrapped by the KEK (driver only)."""
    dek, iv = secrets.token_bytes(32), secrets.token_bytes(IV)
    body = _gcm(dek, iv, plain, "seal")
    b64 = lambda b: base64.b64encode(b).decode()
    return json.dumps({"v": 1, "alg": "A256GCM", "kw": "A256KW", "dek": b64(_wrap(kek, dek, "wrap")), "iv": b64(iv), "ct": b64(body[:-TAG]), "tag": b64(body[-TAG:])}).encode()


def decrypt_bytes(envelope: bytes, kek: bytes) -> bytes:
    e = {k: base64.b64decode(v) if k in ("dek", "iv", "ct", "tag") else v for k, v in json.loads(envelope).items()}
    if e["v"] != 1:
        raise ValueError("unknown envelope")
    return _gcm(_wrap(kek, e["dek"], "unwrap"), e["iv"], e["ct"] + e["tag"], "open")


def generate_kek() -> bytes:
    return secrets.token_bytes(32)


def wrap_with_passphrase(kek: bytes, passphrase: str) -> dict:
    salt = secrets.token_bytes(16)
    outer = hashlib.scrypt(passphrase.encode(), salt=salt, **SCRYPT)
    return {"v": 1, "kdf": "scrypt", "salt": salt.hex(), "wrapped": _wrap(outer, kek, "wrap").hex()}


def unwrap_with_passphrase(blob: dict, passphrase: str) -> bytes:
    outer = hashlib.scrypt(passphrase.encode(), salt=bytes.fromhex(blob["salt"]), **SCRYPT)
    return _wrap(outer, bytes.fromhex(blob["wrapped"]), "unwrap")


def protect_with_keyfile(data: bytes, path: str) -> bytes:
    if not os.path.exists(path):
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(secrets.token_bytes(32))
    with open(path, "rb") as f:
        key = f.read()
    iv = secrets.token_bytes(IV)
    return bytes([VERSION]) + iv + _gcm(key, iv, data, "seal")


def unprotect_with_keyfile(blob: bytes, path: str) -> bytes:
    with open(path, "rb") as f:
        return _gcm(f.read(), blob[1 : 1 + IV], blob[1 + IV :], "open")


class LocalKms:
    """Key service in this process; blobs name their service: id:v1:base64."""

    id = "local"

    def __init__(self, key: bytes):
        self._key = key

    def seal(self, plain: bytes) -> str:
        iv = secrets.token_bytes(IV)
        return f"{self.id}:v1:" + base64.b64encode(iv + _gcm(self._key, iv, plain, "seal", self.id.encode())).decode()

    def open(self, blob: str) -> bytes:
        raw = base64.b64decode(blob.split(":", 2)[2])
        return _gcm(self._key, raw[:IV], raw[IV:], "open", self.id.encode())


def seal_kek(provider, kek: bytes) -> str:
    return provider.seal(kek)


def open_kek(blob: str, providers: dict) -> bytes:
    name, version, _ = blob.split(":", 2)
    if name not in providers or version != "v1":
        raise KeyError(f"no key service {name!r}")
    return providers[name].open(blob)


def get_kek(injected: bytes | None = None, keyfile: tuple[bytes, str] | None = None, allow_ephemeral: bool = False) -> bytes:
    """Injected, else from a key file, else none: an ephemeral key must be allowed."""
    if injected is not None:
        return injected
    if keyfile is not None:
        return unprotect_with_keyfile(*keyfile)
    if not allow_ephemeral:
        raise PermissionError("no durable key")
    return generate_kek()
