"""Identities: hashes, labels, slugs and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(content) -> Column:
    """SHA-256 of a document's bytes or text, in hexadecimal."""
    return F.sha2(content, 256)


def chunk_id(document, content) -> Column:
    """Equal texts in one document share an id, so that they collapse in an upsert."""
    return F.sha2(F.concat(document, F.lit(":"), content), 256)


def fact_id(subj, rel, obj, chunk) -> Column:
    """The first eight bytes of a SHA-256 over the four parts, without the sign bit."""
    digest = F.sha2(F.concat_ws("\x00", subj, rel, obj, chunk), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(2**63 - 1))


def fact_label(fact) -> Column:
    """The first six of sixteen hexadecimal digits; small numbers all give 000000."""
    return F.substring(F.lpad(F.lower(F.hex(fact)), 16, "0"), 1, 6)


def query_key(query, center, author) -> Column:
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (query, center, author)))


def slug(name) -> Column:
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def email_slug(address) -> Column:
    return F.regexp_replace(F.lower(F.trim(address)), "[^a-z0-9_.-]", "_")


def dedup_key(query, context) -> Column:
    return F.sha2(F.concat(query, F.lit("|||"), F.substring(context, 1, 500)), 256)


def caller(header) -> Column:
    """A caller's identity; no header is the anonymous owner."""
    return F.lower(F.trim(F.coalesce(header, F.lit(""))))


def url_tail(url) -> Column:
    """The last part of a citation's address."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
