"""Identifiers: canonical UUIDs, name-based UUIDs, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _hyphenate(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated UUID, or null when the text is not one."""
    stripped = F.regexp_replace(F.regexp_replace(F.lower(text), r"^urn:uuid:", ""), r"[{}-]", "")
    return F.when(stripped.rlike("^[0-9a-f]{32}$"), _hyphenate(stripped))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of ``name``: SHA-1 of namespace bytes and name, version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    return _hyphenate(
        F.concat(
            F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3),
            variant, F.substring(digest, 18, 15),
        )
    )


def candidate_id(version: Column, index: Column, geometry_json: Column) -> Column:
    """Deterministic parcel id of a refined candidate."""
    return uuid5(F.concat_ws(":", version, index.cast("string"), geometry_json))


def shape_keys(rings: Column) -> list[Column]:
    """128-bit identity of a geometry, used to group exact copies."""
    return [F.xxhash64(rings), F.xxhash64(F.lit("shape"), rings)]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
