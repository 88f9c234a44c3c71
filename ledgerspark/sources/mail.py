"""Raw e-mails as columns: headers and attachments, by byte ranges of the message as it came."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime
from ..operators.signatures import tag

SCHEMA = "from_addr string, original_from string, to_addr string, subject string, sent_at timestamp, original binary, has_image boolean, signed_headers string, d_domain string, selector string, l_tag_present boolean"


def _attached(raw: Column, text: Column, parts: Column) -> Column:
    """The bytes of the first message among the parts; null without one."""
    part = F.get(F.filter(parts, lambda p: p["kind"] == "message/rfc822"), 0)
    body = F.substr(raw, (part["start"] + 1).cast("int"), (part["stop"] - part["start"]).cast("int"))
    return F.when(part.isNotNull(), mime.decoded(body, mime.field(part["header"], "content-transfer-encoding")))


def _described(raw: Column) -> Column:
    """A message as a struct of SCHEMA."""

    def outer(text: Column) -> Column:
        header = mime.head(text)["header"]

        def with_parts(parts: Column) -> Column:
            image = F.exists(parts, lambda p: p["kind"].startswith("image/"))
            return mime.let(_attached(raw, text, parts), lambda o: mime.let(mime.head(mime.latin(o))["header"], lambda h: inner(o, h, image)))

        def inner(original: Column, h: Column, image: Column) -> Column:
            signature = mime.field(h, "dkim-signature")
            return F.struct(
                mime.address(mime.field(header, "from")).alias("from_addr"), mime.address(mime.field(h, "from")).alias("original_from"), mime.address(mime.field(h, "to")).alias("to_addr"),
                mime.words(mime.field(h, "subject")).alias("subject"), mime.date(mime.field(h, "date")).alias("sent_at"), original.alias("original"), image.alias("has_image"),
                tag(signature, "h").alias("signed_headers"), F.lower(tag(signature, "d")).alias("d_domain"), tag(signature, "s").alias("selector"), F.coalesce(tag(signature, "l").isNotNull(), F.lit(False)).alias("l_tag_present"),
            )

        return mime.let(mime.parts(text), with_parts)

    return mime.let(mime.latin(F.coalesce(raw, F.lit(b""))), outer)


def parse_messages(messages: DataFrame, column: str = "content") -> DataFrame:
    """messages with the struct `mail` of SCHEMA, and content_hash of the attached original (null without one).

    from_addr and has_image are the message's; the original is the first message attached to it, byte for byte as it stands there (a
    transfer encoding is undone), and the other fields are that one's. Addresses keep their case. Null, empty and malformed
    messages have nulls. The signature isn't verified here (operators.signatures.verify).
    """
    parsed = messages.withColumn("mail", _described(F.col(column)))
    return parsed.withColumn("content_hash", F.sha2("mail.original", 256))


def _signed(body: pd.Series, signature: pd.Series, secret: pd.Series) -> pd.Series:
    return pd.Series([signature_matches(b, s, k) for b, s, k in zip(body, signature, secret, strict=True)], dtype=bool)


def signature_matches(body: bytes, signature: str | None, secret: str) -> bool:
    """Whether the signature is the body's HMAC-SHA256 in hexadecimal, compared in constant time."""
    if not signature:
        return False
    return hmac.compare_digest(hmac.new(secret.encode(), bytes(body), hashlib.sha256).hexdigest(), signature)


def verified(requests: DataFrame, secret: str) -> DataFrame:
    """requests (body, signature) with `genuine`."""
    return requests.withColumn("genuine", F.pandas_udf(_signed, "boolean")(F.col("body"), F.col("signature"), F.lit(secret)))
