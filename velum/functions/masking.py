"""Replacement strategies for a detected value, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategies, the types they belong to, and the replacement formats.
STRATEGIES = ("redact", "mask", "hash", "encrypt", "generalize", "suppress", "synthetic")

STRATEGY_BY_TYPE = {
    "SSN": "hash",
    "CREDIT_CARD": "hash",
    "EMAIL": "mask",
    "PHONE_NUMBER": "mask",
    "PERSON": "generalize",
    "LOCATION": "generalize",
    "OTHER": "suppress",
}

GENERAL_LABEL = {
    "PERSON": "[Person]",
    "LOCATION": "[Location]",
    "ORGANIZATION": "[Organization]",
    "DATE_OF_BIRTH": "[Date]",
    "AGE": "[Age Range: 25-35]",
}

SYNTHETIC_VALUE = {
    "EMAIL": "user@example.com",
    "PHONE_NUMBER": "(555) 555-5555",
    "PERSON": "John Doe",
    "SSN": "000-00-0000",
    "CREDIT_CARD": "0000-0000-0000-0000",
    "LOCATION": "City, State",
}

# Field-name fragments and the type they suggest, first match wins.
FIELD_HINTS = (
    (("email",), "EMAIL"),
    (("phone",), "PHONE_NUMBER"),
    (("ssn", "social_security"), "SSN"),
    (("credit", "card"), "CREDIT_CARD"),
    (("name",), "PERSON"),
    (("address",), "LOCATION"),
    (("password",), "OTHER"),
)


def _choose(key: Column, table: Mapping[str, str], default: Column) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return default if out is None else out.otherwise(default)


def redact(value: Column, pii_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), pii_type, F.lit("]"))


def mask(value: Column, pii_type: Column) -> Column:
    local, host = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    email = F.when(
        value.contains("@") & (F.length(local) > 1),
        F.concat(F.substring(local, 1, 1), F.lit("***@"), host),
    ).otherwise("***@***.com")

    digits = F.regexp_replace(value, "[^0-9]", "")
    tail = F.right(digits, F.lit(4))

    def last_four(stars: str) -> Column:
        return F.concat(F.lit(stars), F.when(F.length(digits) >= 4, tail).otherwise("****"))

    n = F.length(value)
    plain = F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(value, F.lit(1)))
    )
    return (
        F.when(pii_type == "EMAIL", email)
        .when(pii_type == "PHONE_NUMBER", last_four("***-***-"))
        .when(pii_type == "CREDIT_CARD", last_four("****-****-****-"))
        .otherwise(plain)
    )


def hashed(value: Column, pii_type: Column | None = None) -> Column:
    return F.concat(F.lit("[HASH:"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]"))


def generalize(value: Column, pii_type: Column) -> Column:
    return _choose(pii_type, GENERAL_LABEL, F.concat(F.lit("["), pii_type, F.lit("]")))


def synthetic(value: Column, pii_type: Column) -> Column:
    return _choose(pii_type, SYNTHETIC_VALUE, F.concat(F.lit("[SYNTHETIC_"), pii_type, F.lit("]")))


def encrypt(value: Column, pii_type: Column, key: Column | None = None) -> Column:
    """Reversible AES-GCM with the caller's key; without one, the bare type label."""
    if key is None:
        return F.concat(F.lit("["), pii_type, F.lit("]"))
    return F.base64(F.aes_encrypt(value, key))


def strategy_for(pii_type: Column, default: Column | str, overrides: Mapping[str, str] | None = None) -> Column:
    """The type's own strategy where there is one, else ``default``."""
    default = F.lit(default) if isinstance(default, str) else default
    return _choose(pii_type, {**STRATEGY_BY_TYPE, **(overrides or {})}, default)


def apply_strategy(value: Column, pii_type: Column, strategy: Column, key: Column | None = None) -> Column:
    return (
        F.when(strategy == "redact", redact(value, pii_type))
        .when(strategy == "mask", mask(value, pii_type))
        .when(strategy == "hash", hashed(value))
        .when(strategy == "generalize", generalize(value, pii_type))
        .when(strategy == "suppress", F.lit(""))
        .when(strategy == "synthetic", synthetic(value, pii_type))
        .otherwise(encrypt(value, pii_type, key))
    )


def replacement(
    value: Column, pii_type: Column, default: str = "mask", overrides: Mapping[str, str] | None = None, key: Column | None = None
) -> Column:
    return apply_strategy(value, pii_type, strategy_for(pii_type, default, overrides), key)


def type_from_field_name(name: Column) -> Column:
    low, out = F.lower(name), None
    for words, pii_type in FIELD_HINTS:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = F.when(test, pii_type) if out is None else out.when(test, pii_type)
    return out.otherwise("OTHER")
