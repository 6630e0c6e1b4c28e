"""Suppression: listings that are customers already, found by salted fingerprints of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.functions.text import customer_keys, fingerprint
from plotmere.operators.shared import dealt


def fingerprints(customers: DataFrame, salt: str) -> DataFrame:
    """Distinct hash of all keys of customers (name, phone, address, city, zip)."""
    keys = customer_keys(*(F.col(c) for c in ("name", "phone", "address", "city", "zip")))
    return dealt(customers).select(F.explode(keys).alias("key")).select(fingerprint(salt, F.col("key")).alias("hash")).distinct()


def known(listings: DataFrame, hashes: DataFrame, salt: str, key: str) -> DataFrame:
    """Distinct key of listings that share a fingerprint."""
    keys = customer_keys(*(F.col(c) for c in ("name", "phone", "address", "city", "zip")))
    own = dealt(listings).select(key, F.explode(keys).alias("k")).select(key, fingerprint(salt, F.col("k")).alias("hash"))
    return own.join(hashes.select("hash"), "hash", "left_semi").select(key).distinct()


def leave_out(listings: DataFrame, hashes: DataFrame, salt: str, key: str) -> DataFrame:
    return listings.join(known(listings, hashes, salt, key), key, "left_anti")


def usable(customers: DataFrame) -> DataFrame:
    """One row: the customers that have a key."""
    keys = customer_keys(*(F.col(c) for c in ("name", "phone", "address", "city", "zip")))
    return dealt(customers).agg(F.count_if(F.size(keys) > 0).alias("usable"))
