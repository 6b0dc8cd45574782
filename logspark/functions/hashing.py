"""64-bit hashes from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Fixed value: prefix of the user hash, so ids stay stable across installs.
USER_HASH_PREFIX = "cl-user-v1"


def hash64_hex(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def hash64(text: Column) -> Column:
    """First 8 bytes of SHA-256 as an unsigned number."""
    return F.conv(hash64_hex(text), 16, 10).cast("decimal(20,0)")


def signed64(text: Column) -> Column:
    """First 8 bytes of SHA-256 as a signed long, cheaper to shuffle and compare."""
    return F.conv(hash64_hex(text), 16, -10).cast("long")


def user_hash(site: Column, user: Column) -> Column:
    """Stable per-site user hash; empty users stay NULL."""
    keyed = F.concat_ws("|", F.lit(USER_HASH_PREFIX), site, user)
    return F.when(F.coalesce(user, F.lit("")) != "", hash64(keyed))


def visitor_hash(salt: Column, site: Column, ip: Column, agent: Column) -> Column:
    """Daily visitor hash: the salt rotates with the event's date, the address is not kept."""
    blank = F.lit("")
    return hash64(
        F.concat(
            salt, F.lit("|"), site, F.lit("|"), F.coalesce(ip, blank), F.lit("|"),
            F.coalesce(agent, blank),
        )
    )


def session_key(site: Column, visitor: Column, first_view: Column) -> Column:
    """Session id: a hash of the site, the visitor and the first page view's millisecond."""
    return signed64(F.concat_ws("|", site, visitor.cast("string"), F.unix_millis(first_view)))
