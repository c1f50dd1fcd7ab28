"""Severity, articles and advice of a finding, per kind of source, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which type has which severity, per kind of source.
SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")

SEVERITY = {
    "document": {
        "critical": ("SSN", "CREDIT_CARD", "PASSPORT"),
        "high": ("MEDICAL_LICENSE", "DRIVER_LICENSE", "EMAIL", "PHONE_NUMBER", "IBAN"),
        "medium": ("DATE_OF_BIRTH", "LOCATION", "PERSON", "IP_ADDRESS"),
        "low": ("ORGANIZATION", "URL", "OTHER"),
    },
    "web": {
        "critical": ("SSN", "CREDIT_CARD", "PASSPORT"),
        "high": ("EMAIL", "PHONE_NUMBER", "IBAN"),
        "medium": ("PERSON", "LOCATION", "IP_ADDRESS"),
    },
    "database": {
        "critical": ("SSN", "CREDIT_CARD", "PASSPORT", "MEDICAL_LICENSE", "CRYPTO_ADDRESS"),
        "high": ("DATE_OF_BIRTH", "DRIVER_LICENSE"),
    },
}

# Fixed values: (types, articles) in order of precedence; the last entry is the default.
ARTICLES = {
    "document": (
        (("SSN", "MEDICAL_LICENSE", "DATE_OF_BIRTH"), ("Art. 5", "Art. 9", "Art. 32")),
        (("CREDIT_CARD", "IBAN"), ("Art. 5", "Art. 6", "Art. 32")),
        ((), ("Art. 5", "Art. 6")),
    ),
    "web": (
        (("SSN", "MEDICAL_LICENSE"), ("Art. 5", "Art. 9", "Art. 32")),
        (("CREDIT_CARD", "IBAN"), ("Art. 5", "Art. 6", "Art. 32")),
        ((), ("Art. 5", "Art. 6")),
    ),
    "database": (
        (("SSN", "MEDICAL_LICENSE", "PASSPORT"), ("Art. 9", "Art. 32")),
        ((), ("Art. 6", "Art. 32")),
    ),
}

# Our own wording.
ADVICE = {
    "document": {
        "SSN": "Delete the number or keep it only as a token behind strict access rules.",
        "CREDIT_CARD": "Take card numbers out of the document; keep payments in a certified vault.",
        "PASSPORT": "Keep passport numbers encrypted and limit who may read them.",
        "EMAIL": "Check that the address is still needed and let its owner opt out.",
        "PHONE_NUMBER": "Check that the number was given with consent and let its owner opt out.",
        "IBAN": "Encrypt account numbers and record every access to them.",
        "PERSON": "State why the name is kept and drop it where it is not needed.",
        "LOCATION": "Limit what locations are used for and when they are deleted.",
        "IP_ADDRESS": "Shorten or drop addresses once they have served their purpose.",
    },
    "web": {
        "EMAIL": "Take the address off the page and offer a contact form.",
        "PHONE_NUMBER": "Take the number off the page or put it behind a call button.",
        "SSN": "CRITICAL: take social security numbers off public pages now.",
        "CREDIT_CARD": "CRITICAL: take card data off public pages now.",
    },
}
DEFAULT_ADVICE = {
    "document": "Check whether this data is needed and protect it accordingly.",
    "web": "Check whether this data has to be public; remove it or restrict access.",
    "database": "Encrypt the column, restrict access and set a retention period.",
}


def severity(pii_type: Column, confidence: Column | None = None, profile: str = "document") -> Column:
    """Severity of a type; the document profile lowers it when the detector was unsure."""
    levels = SEVERITY[profile]
    out = None
    for level, types in levels.items():
        test = pii_type.isin(*types)
        value = F.lit(level)
        if profile == "document" and confidence is not None:
            if level == "critical":
                value = F.when(confidence < 0.7, "high").otherwise("critical")
            elif level == "high":
                value = F.when(confidence < 0.6, "medium").otherwise("high")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise("medium")


def articles(pii_type: Column, profile: str = "document") -> Column:
    out = None
    for types, names in ARTICLES[profile]:
        value = F.array(*[F.lit(n) for n in names])
        if not types:
            return out.otherwise(value)
        out = F.when(pii_type.isin(*types), value) if out is None else out.when(pii_type.isin(*types), value)
    return out


def advice(pii_type: Column, sev: Column, profile: str = "document") -> Column:
    out = None
    for name, text in ADVICE.get(profile, {}).items():
        out = F.when(pii_type == name, text) if out is None else out.when(pii_type == name, text)
    base = F.lit(DEFAULT_ADVICE[profile]) if out is None else out.otherwise(DEFAULT_ADVICE[profile])
    if profile != "document":
        return base
    return (
        F.when(sev == "critical", F.concat(F.lit("CRITICAL: "), base, F.lit(" Immediate action required.")))
        .when(sev == "high", F.concat(F.lit("HIGH PRIORITY: "), base))
        .otherwise(base)
    )


def severity_rank(sev: Column, other: int = 4) -> Column:
    """critical 0, high 1, medium 2, low 3; anything else ``other``."""
    out = F.when(sev == "critical", 0)
    for i, level in enumerate(SEVERITY_ORDER[1:4], start=1):
        out = out.when(sev == level, i)
    return out.otherwise(other)


def location_label(page_number: Column) -> Column:
    """``Page n``, or ``Document`` where there is no page (or page 0)."""
    has_page = page_number.isNotNull() & (page_number != 0)
    return F.when(has_page, F.concat(F.lit("Page "), page_number.cast("string"))).otherwise("Document")
