"""Values of whole texts that a pattern finds and a validator confirms, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.personal_rules import CARD, IBAN, NATIONAL_ID
from ..functions.props import redacted

MOST_SAMPLES = 10
#: type -> (pattern, validator, form of the value)
NATIVE = {
    "gdpr_email_address": (v.EMAIL, v.valid_email, lambda x: x),
    "gdpr_national_id": (NATIONAL_ID, lambda x: F.lit(True), lambda x: F.upper(F.regexp_replace(x, "[ -]", ""))),
    "gdpr_payment_card_data": (CARD, v.valid_card, lambda x: x),
    "gdpr_bank_account_data": (IBAN, v.valid_iban, F.upper),
}


def values(text: Column | str, kind: str) -> Column:
    """Distinct valid matches of a detector in their order, not redacted."""
    pattern, valid, formed = NATIVE[kind]
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.coalesce(valid(x), F.lit(False))), formed))


def samples(text: Column | str, kind: str) -> Column:
    return F.slice(F.array_distinct(F.transform(values(text, kind), lambda x: redacted(x, squeeze=True))), 1, MOST_SAMPLES)
