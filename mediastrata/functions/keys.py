"""Key files and configured keys. Private keys are read on the driver and travel only inside signing functions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from mediastrata.functions.ed25519 import SigningKey
from mediastrata.operators.policy import DEFAULT_TTP_NAME
from mediastrata.plans.manifests import Signers

#: Session settings for the trusted third party: its public key (hex), the path of its private key file, and its display name.
TTP_PUBLIC, TTP_PRIVATE_FILE, TTP_NAME = "mediastrata.ttp.publicKey", "mediastrata.ttp.privateKeyFile", "mediastrata.ttp.name"


def load(path: str) -> SigningKey:
    """A raw 32-byte private key file; any other length is an error."""
    with open(path, "rb") as f:
        return SigningKey(f.read())


def generate(private_path: str, public_path: str | None = None) -> SigningKey:
    """Writes a new private key, readable by its owner only, and its public key as hex."""
    key = SigningKey.generate()
    fd = os.open(private_path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "wb") as f:
        f.write(key.seed)
    if public_path:
        with open(public_path, "w") as f:
            f.write(key.public_key().hex())
    return key


def ttp_public(spark: SparkSession) -> str:
    """The configured public key of the trusted third party, else that of its private key."""
    found = spark.conf.get(TTP_PUBLIC, None)
    return found.lower() if found else ttp_private(spark).public_key().hex()


def ttp_private(spark: SparkSession) -> SigningKey:
    path = spark.conf.get(TTP_PRIVATE_FILE, None)
    if not path:
        raise ValueError(f"{TTP_PRIVATE_FILE} isn't set")
    return load(path)


def signers(spark: SparkSession, author_key: SigningKey, author_name: str | None = None) -> Signers:
    """Who signs; a private key of the third party that doesn't belong to its configured public key is an error."""
    ttp = ttp_private(spark)
    if ttp.public_key().hex() != ttp_public(spark):
        raise ValueError("the trusted third party's keys aren't a pair")
    return Signers(author_key, ttp, author_name, spark.conf.get(TTP_NAME, None) or DEFAULT_TTP_NAME)
