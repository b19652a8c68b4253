"""Customer conforming and identity resolution by hashed contact keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.functions.columns import clean_upper, hashed_id, with_expr


def resolve_identity(customers: DataFrame) -> DataFrame:
    """Add ``resolved_identity_id`` and how it was matched.

    Customers that lack both hashes share one id, because the id depends on the two
    hashes alone.
    """
    return with_expr(
        customers,
        country=clean_upper("country"),
        risk_segment=clean_upper("risk_segment"),
        resolved_identity_id=hashed_id(
            "coalesce(email_hash, 'missing-email')", "coalesce(phone_hash, 'missing-phone')"
        ),
        identity_match_method=(
            "CASE WHEN email_hash IS NOT NULL AND phone_hash IS NOT NULL "
            "THEN 'EMAIL_AND_PHONE_HASH' ELSE 'PARTIAL_HASH_IDENTITY' END"
        ),
    )
