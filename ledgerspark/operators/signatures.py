"""DKIM signatures (RFC 6376) over a table of keys: canonical forms, body hash and what is signed are built-in expressions; only the
RSA step, a power of the signature, is done in Python, in Arrow batches."""

from __future__ import annotations

import base64
import binascii
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mime import fields, head, latin, let, unlatin

#: The ASN.1 prefix of a digest that is signed by PKCS#1 v1.5, by algorithm.
PREFIX = {"rsa-sha256": "3031300d060960864801650304020105000420", "rsa-sha1": "3021300906052b0e03021a05000414"}
LEAST_BITS = 1024


def canonical_body(body: Column, relaxed: Column) -> Column:
    """A body in the simple or the relaxed form; bare line feeds count as line ends."""
    lines = F.regexp_replace(body, r"\r?\n", "\r\n")
    packed = F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r" (?=\r\n|\z)", "")
    cut = let(F.regexp_replace(packed, r"(?:\r\n)++\z", ""), lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("\r\n"))))
    return F.when(relaxed, cut).otherwise(F.concat(F.regexp_replace(lines, r"(?:\r\n)++\z", ""), F.lit("\r\n")))


def canonical_field(text: Column, relaxed: Column) -> Column:
    """A header field in the simple or the relaxed form, without the line end after it."""
    name = F.lower(F.btrim(F.regexp_extract(text, r"^[^:]*", 0), F.lit(" \t")))
    value = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[^:]*:", ""), r"\r?\n", ""), r"[ \t]+", " ")
    return F.when(relaxed, F.concat(name, F.lit(":"), F.btrim(value))).otherwise(F.regexp_replace(text, r"\r?\n", "\r\n"))


def tag(value: Column, name: str) -> Column:
    """A signature's tag without white space; null without one."""
    found = F.regexp_extract(value, rf"(?:^|;)\s*{name}\s*=\s*([^;]*)", 1)
    return F.nullif(F.regexp_replace(found, r"\s+", ""), F.lit(""))


def field_name(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_extract(text, r"^[^:]*", 0), F.lit(" \t")))


def signature(original: Column) -> Column:
    """Of a message's bytes, its first signature: the tags a, b, d, s, h, l and x, whether the body has the hash that it names (body_ok), and
    the digest in hexadecimal of what it signs. Null without a signature or a message.

    Of a name in h the fields are taken from the last one up; a name that stands there more often than in the header adds nothing.
    With l only so much of the canonical body counts.
    """

    def signed(text: Column) -> Column:
        def own(h: Column) -> Column:
            listed = F.transform(fields(h["header"]), lambda f: F.struct(field_name(f).alias("name"), f.alias("text")))
            return let(listed, lambda all_: _signature(F.substr(text, h["body"] + 1), all_))

        return let(head(text), own)

    return F.when(original.isNotNull(), let(latin(original), signed))


def _signature(body: Column, listed: Column) -> Column:
    first = F.get(F.filter(listed, lambda f: f["name"] == "dkim-signature"), 0)["text"]

    def of(text: Column) -> Column:
        value = F.regexp_replace(text, r"^[^:]*:", "")
        forms = F.split(F.lower(F.coalesce(tag(value, "c"), F.lit("simple/simple"))), "/")
        head_relaxed, body_relaxed = F.get(forms, 0) == "relaxed", F.coalesce(F.get(forms, 1) == "relaxed", F.lit(False))
        names = F.filter(F.split(F.lower(F.coalesce(tag(value, "h"), F.lit(""))), ":"), lambda n: n != "")

        def taken(name: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda n: n == name))  # from the last one up
            same = F.filter(listed, lambda f: f["name"] == name)
            return F.when(nth <= F.size(same), F.concat(canonical_field(F.get(same, F.size(same) - nth)["text"], head_relaxed), F.lit("\r\n"))).otherwise("")

        empty = F.concat(F.regexp_extract(text, r"^[^:]*:", 0), F.regexp_replace(value, r"((?:^|;)\s*b\s*=)[^;]*", "$1"))
        what = unlatin(F.concat(F.array_join(F.transform(names, taken), ""), canonical_field(empty, head_relaxed)))
        limit = tag(value, "l").try_cast("int")
        form = canonical_body(body, body_relaxed)
        hashed = unlatin(F.when(limit.isNotNull(), F.substr(form, F.lit(1), limit)).otherwise(form))
        old = F.lower(tag(value, "a")) == "rsa-sha1"
        digest = lambda x: F.when(old, F.sha1(x)).otherwise(F.sha2(x, 256))
        return F.struct(
            F.lower(tag(value, "a")).alias("a"), tag(value, "b").alias("b"), F.lower(tag(value, "d")).alias("d"), tag(value, "s").alias("s"), tag(value, "h").alias("h"), tag(value, "l").alias("l"),
            tag(value, "x").try_cast("long").alias("x"), (F.base64(F.unhex(digest(hashed))) == tag(value, "bh")).alias("body_ok"), digest(what).alias("digest"),
        )

    return F.when(first.isNotNull(), let(first, of))


def _items(data: bytes):
    """The elements of a DER sequence's content: (tag, content)."""
    at = 0
    while at < len(data):
        kind, size, at = data[at], data[at + 1], at + 2
        if size & 128:
            n = size & 127
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            raise ValueError("cut off")
        yield kind, data[at : at + size]
        at += size


def public_key(text: str) -> tuple[int, int]:
    """Modulus and exponent of an RSA key in base64 DER: a SubjectPublicKeyInfo, or the bare key in it."""
    data = base64.b64decode(text, validate=True)
    inner = list(_items(next(_items(data))[1]))
    if inner[0][0] == 0x30:
        inner = list(_items(next(_items(inner[1][1][1:]))[1]))  # a bit string, after its number of unused bits
    return tuple(int.from_bytes(x[1], "big") for x in inner[:2])


def rsa_result(algorithm: str, digest: str, signed: str, key: str) -> str:
    """pass, fail, neutral (no usable key) or policy (a short one)."""
    try:
        modulus, exponent = public_key(key)
    except (ValueError, IndexError, StopIteration, binascii.Error):
        return "neutral"
    if modulus.bit_length() < LEAST_BITS:
        return "policy"
    size = (modulus.bit_length() + 7) // 8
    inner = bytes.fromhex(PREFIX[algorithm] + digest)
    want = b"\x00\x01" + b"\xff" * (size - len(inner) - 3) + b"\x00" + inner
    try:
        given = base64.b64decode(signed, validate=True)
    except (ValueError, binascii.Error):
        return "fail"
    number = int.from_bytes(given, "big")
    return "pass" if len(given) == size and number < modulus and pow(number, exponent, modulus).to_bytes(size, "big") == want else "fail"


def _rsa(algorithm: pd.Series, digest: pd.Series, signed: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else rsa_result(a, d, s, k) for a, d, s, k in zip(algorithm, digest, signed, key, strict=True)], dtype=object)


def verify(messages: DataFrame, keys: DataFrame, original: str = "original", now: datetime | None = None) -> DataFrame:
    """messages with dkim, selector, d_domain, signed_headers, l_tag_present and public_key, replacing columns of these names.

    keys (selector, domain, key) has the text of each key's record (v=DKIM1; k=rsa; p=...); a null key is one that couldn't be looked
    up. dkim is none (no signature, or no original), permerror (a tag is missing, or the algorithm is none of PREFIX), neutral (no key, a
    withdrawn or unreadable one, or another body hash), policy (a key of less than 1024 bits, or past its x where now is
    given), temperror (a null key), pass or fail. Only the first signature of a message counts. Of several records of
    one selector and domain the smallest text counts.
    """
    record = keys.select(F.col("selector").alias("_s"), F.lower("domain").alias("_d"), F.col("key").alias("_key")).groupBy("_s", "_d").agg(F.min("_key").alias("_key"), F.lit(True).alias("_known"))
    rows = messages.drop("dkim", "selector", "d_domain", "signed_headers", "l_tag_present", "public_key").withColumn("_sig", signature(F.col(original)))
    sig = F.col("_sig")
    rows = rows.join(record, (sig["s"] == F.col("_s")) & (sig["d"] == F.col("_d")), "left")
    whole = F.forall(F.array(*(sig[c] for c in "abdsh")), lambda x: x.isNotNull()) & sig["body_ok"].isNotNull() & sig["a"].isin(*PREFIX)
    public = F.nullif(F.coalesce(tag(F.col("_key"), "p"), F.when(~F.col("_key").rlike(r"^\s*[a-z]+\s*=|;"), F.col("_key"))), F.lit(""))
    usable = F.coalesce(F.lower(tag(F.col("_key"), "k")), F.lit("rsa")) == "rsa"
    tried = F.when(whole & sig["body_ok"] & usable, public)
    rows = rows.withColumn("_rsa", F.pandas_udf(_rsa, "string")(sig["a"], sig["digest"], sig["b"], tried))
    late = F.coalesce(sig["x"] < int(now.timestamp()), F.lit(False)) if now else F.lit(False)
    result = (
        F.when(sig.isNull(), "none").when(~F.coalesce(whole, F.lit(False)), "permerror").when(F.col("_known") & F.col("_key").isNull(), "temperror")
        .when(F.col("_rsa").isNull(), "neutral").when((F.col("_rsa") == "pass") & late, "policy").otherwise(F.col("_rsa"))
    )
    out = rows.withColumns({
        "dkim": result, "selector": sig["s"], "d_domain": sig["d"], "signed_headers": sig["h"], "l_tag_present": F.coalesce(sig["l"].isNotNull(), F.lit(False)),
        "public_key": F.when(sig.isNotNull() & F.col("_rsa").isNotNull(), public),
    })
    return out.drop("_sig", "_s", "_d", "_key", "_known", "_rsa")
