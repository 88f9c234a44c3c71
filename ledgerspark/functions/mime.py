"""Messages as columns, in built-in expressions: parts by their byte ranges, header fields, transfer decoding.

Bytes are worked on as ISO-8859-1 text, in which each character is one byte, so places in the text are places in the bytes
and nothing is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"
#: The empty line that ends a header, also where the header is empty.
_BLANK = r"(?:\A|\r?\n)\r?\n"
#: Zones by name that dates may have.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
PART = "struct<depth: int, start: bigint, stop: bigint, kind: string, header: string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def latin(raw: Column) -> Column:
    return F.decode(raw, LATIN)


def unlatin(text: Column) -> Column:
    return F.encode(text, LATIN)


def head(text: Column) -> Column:
    """struct(header, body): the header's text without the empty line that ends it, and how many characters stand before the body."""
    at, gap = F.regexp_instr(text, F.lit(_BLANK)), F.length(F.regexp_extract(text, _BLANK, 0))
    found = let(at, lambda p: F.struct(F.when(p == 0, text).otherwise(F.substr(text, F.lit(1), p - 1)).alias("header"), F.when(p == 0, F.length(text)).otherwise(p - 1 + gap).alias("body")))
    return found


def fields(header: Column) -> Column:
    """The header's fields as they stand, folded lines together."""
    return F.filter(F.split(header, r"\r?\n(?![ \t])"), lambda f: f.contains(":"))


def field(header: Column, name: str) -> Column:
    """The value of the first field of that name, unfolded and trimmed; null without one."""
    unfolded = F.regexp_replace(header, r"\r?\n(?=[ \t])", "")
    # (?d): a line ends at \n alone, as other line ends may be bytes of a longer character
    line = F.regexp_extract(unfolded, rf"(?imd)^{name}[ \t]*:[^\r\n]*", 0)
    return let(line, lambda x: F.when(x != "", F.btrim(F.regexp_replace(x, r"^[^:]*:", ""), F.lit(" \t"))))


def parameter(value: Column, name: str) -> Column:
    """A parameter of a field's value, unquoted; an empty string without one."""
    quoted = F.regexp_extract(value, rf'(?i);\s*{name}\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
    bare = F.regexp_extract(value, rf'(?i);\s*{name}\s*=\s*([^";\s]+)', 1)
    return F.coalesce(F.nullif(F.regexp_replace(quoted, r"\\(.)", "$1"), F.lit("")), bare)


def _segment(seg: Column) -> Column:
    """Of text from a line that may be a delimiter to the next such line: sizes, the delimiter's name, and what the header after it says."""
    line = F.regexp_extract(seg, r"^[^\n]*\n?", 0)

    def described(line: Column) -> Column:
        def with_head(h: Column) -> Column:
            kind = F.coalesce(field(h["header"], "content-type"), F.lit(""))
            return F.struct(
                F.length(seg).cast("long").alias("size"),
                F.when(seg.endswith("\r\n"), 2).when(seg.endswith("\n"), 1).otherwise(0).alias("tail"),
                F.when(line.startswith("--"), F.substr(F.rtrim(line, F.lit(" \t\r\n")), F.lit(3))).alias("name"),
                (F.length(line) + h["body"]).cast("long").alias("body"),
                h["header"].alias("header"),
                F.lower(F.regexp_extract(kind, r"^([^;\s]+)", 1)).alias("kind"),
                F.rtrim(parameter(kind, "boundary"), F.lit(" ")).alias("boundary"),
            )

        return let(head(F.substr(seg, F.length(line) + 1)), with_head)

    return let(line, described)


def parts(text: Column) -> Column:
    """The leaves of a message (as ISO-8859-1 text) in their order, as an array of PART.

    start and stop are the range of a part's body in bytes: it begins after the empty line that ends the part's header and ends
    before the line break that belongs to the next delimiter; kind is the content type in lower case, depth the number of
    multiparts around it. Delimiters of a multipart that was never closed end with those of one around it; text before
    the first delimiter and after the last one is no part. An attached message is one leaf: its own parts aren't
    looked for. A message that isn't a multipart is a single part. Null for null.

    The delimiters are found by a fold over the lines that begin with two hyphens, with the open boundaries as a stack.
    """
    return let(head(text), lambda h: _parts(text, h))


def _parts(text: Column, h: Column) -> Column:
    kind = F.coalesce(field(h["header"], "content-type"), F.lit(""))
    top = F.struct(F.lower(F.regexp_extract(kind, r"^([^;\s]+)", 1)).alias("kind"), F.rtrim(parameter(kind, "boundary"), F.lit(" ")).alias("boundary"))
    none = F.lit(None).cast(PART)
    whole = lambda t: F.array(F.struct(F.lit(0).alias("depth"), h["body"].cast("long").alias("start"), F.length(text).cast("long").alias("stop"), F.when(t["kind"] == "", "text/plain").otherwise(t["kind"]).alias("kind"), h["header"].alias("header")))

    def step(a: Column, s: Column) -> Column:
        opened, closed = F.array_position(a["names"], s["name"]), F.array_position(a["names"], F.regexp_replace(s["name"], "--$", ""))
        opened, closed = F.coalesce(opened, F.lit(0)), F.when(s["name"].endswith("--"), F.coalesce(closed, F.lit(0))).otherwise(0)

        def moved(m: Column) -> Column:
            hit = (m["opened"] > 0) | (m["closed"] > 0)
            nested = (m["opened"] > 0) & s["kind"].startswith("multipart/") & (s["boundary"] != "")
            level = F.when(m["opened"] > 0, m["opened"]).otherwise(F.coalesce(m["closed"], F.lit(0)) - 1).cast("int")
            keep = F.slice(a["names"], F.lit(1), F.greatest(level, F.lit(0)))
            kinds = F.slice(a["kinds"], F.lit(1), F.greatest(level, F.lit(0)))
            plain = F.when(F.element_at(kinds, -1) == "multipart/digest", "message/rfc822").otherwise("text/plain")
            begun = F.struct(level.alias("depth"), (a["at"] + s["body"]).alias("start"), F.lit(0).cast("long").alias("stop"), F.when(s["kind"] == "", plain).otherwise(s["kind"]).alias("kind"), s["header"].alias("header"))
            ended = F.struct(a["open"]["depth"].alias("depth"), a["open"]["start"].alias("start"), F.greatest(a["open"]["start"], a["at"] - a["tail"]).alias("stop"), a["open"]["kind"].alias("kind"), a["open"]["header"].alias("header"))
            return F.struct(
                (a["at"] + s["size"]).alias("at"),
                s["tail"].alias("tail"),
                F.when(~hit, a["names"]).when(nested, F.concat(keep, F.array(s["boundary"]))).otherwise(keep).alias("names"),
                F.when(~hit, a["kinds"]).when(nested, F.concat(kinds, F.array(s["kind"]))).otherwise(kinds).alias("kinds"),
                F.when(~hit, a["open"]).when((m["opened"] > 0) & ~nested, begun).otherwise(none).alias("open"),
                F.when(hit & a["open"].isNotNull(), F.concat(a["parts"], F.array(ended))).otherwise(a["parts"]).alias("parts"),
            )

        return let(F.struct(opened.alias("opened"), closed.alias("closed")), moved)

    def done(a: Column) -> Column:
        last = F.struct(a["open"]["depth"].alias("depth"), a["open"]["start"].alias("start"), F.greatest(a["open"]["start"], a["at"]).alias("stop"), a["open"]["kind"].alias("kind"), a["open"]["header"].alias("header"))
        return F.when(a["open"].isNotNull(), F.concat(a["parts"], F.array(last))).otherwise(a["parts"])

    def folded(t: Column) -> Column:
        start = F.struct(
            h["body"].cast("long").alias("at"), F.lit(0).alias("tail"), F.array(t["boundary"]).alias("names"), F.array(t["kind"]).alias("kinds"), none.alias("open"), F.array().cast(f"array<{PART}>").alias("parts"),
        )
        lines = F.transform(F.split(F.substr(text, h["body"] + 1), r"(?<=\n)(?=--)"), _segment)
        return F.when(t["kind"].startswith("multipart/") & (t["boundary"] != ""), F.aggregate(lines, start, step, done)).otherwise(whole(t))

    return F.when(text.isNotNull(), let(top, folded))


def decoded(raw: Column, encoding: Column) -> Column:
    """The bytes that a body in a transfer encoding stands for; of any but base64 and quoted-printable, the body as it is."""
    kind = F.lower(F.btrim(F.coalesce(encoding, F.lit("")), F.lit(" \t\"")))
    digits = F.regexp_replace(latin(raw), "[^A-Za-z0-9+/]+", "")
    base64 = let(digits, lambda d: F.unbase64(F.concat(F.substr(d, F.lit(1), F.length(d) - F.when(F.length(d) % 4 == 1, 1).otherwise(0)), F.when(F.length(d) % 4 == 2, "==").when(F.length(d) % 4 == 3, "=").otherwise(""))))
    text = F.regexp_replace(F.regexp_replace(latin(raw), r"[ \t]+(?=\r?\n|\z)", ""), r"=(?:\r?\n|\z)", "")
    return F.when(kind == "base64", base64).when(kind == "quoted-printable", escaped(text)).otherwise(raw)


def escaped(text: Column) -> Column:
    """The bytes of text in which =XX stands for a byte."""
    one = lambda t: F.when(t.rlike("^=[0-9A-Fa-f]{2}$"), F.substr(t, F.lit(2))).otherwise(F.hex(unlatin(t)))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("=[0-9A-Fa-f]{2}|[^=]+|="), F.lit(0)), one), ""))


def unicode(text: Column) -> Column:
    """Text of bytes as UTF-8 where they are that, else as it is."""
    return F.coalesce(F.try_validate_utf8(unlatin(text).cast("string")), text)


def words(value: Column) -> Column:
    """A field's value with encoded words (RFC 2047) in UTF-8, ASCII and ISO-8859-1 written out; others stay."""
    encoded = r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?="
    joined = F.regexp_replace(value, r"(\?=)[ \t]+(?==\?[^?\s]+\?[bBqQ]\?)", "$1")

    def one(t: Column) -> Column:
        charset, kind, body = F.lower(F.regexp_extract(t, encoded, 1)), F.lower(F.regexp_extract(t, encoded, 2)), F.regexp_extract(t, encoded, 3)
        raw = F.when(kind == "b", decoded(unlatin(body), F.lit("base64"))).otherwise(escaped(F.replace(body, F.lit("_"), F.lit(" "))))
        known = F.when(charset.isin("utf-8", "utf8", "us-ascii"), F.make_valid_utf8(raw.cast("string"))).when(charset.isin("iso-8859-1", "latin1"), latin(raw))
        return F.when(t.rlike(f"^{encoded}$"), F.coalesce(known, t)).otherwise(unicode(t))

    tokens = F.regexp_extract_all(joined, F.lit(r"=\?[^?\s]+\?[bBqQ]\?[^?]*\?=|(?:(?!=\?)[\s\S])+|=\?"), F.lit(0))
    return F.when(value.isNotNull(), F.array_join(F.transform(tokens, one), ""))


def address(value: Column) -> Column:
    """The first address of a field's value, in its own case; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(value, r'"(?:[^"\\]|\\.)*"', ""), r"\([^()]*\)", "")
    first = F.get(F.split(F.regexp_replace(bare, r"^[^<>@,]*:", ""), ","), 0)  # a group's name goes
    inner = F.nullif(F.btrim(F.regexp_extract(first, "<([^<>]*)>", 1), F.lit(" \t")), F.lit(""))
    return F.coalesce(inner, F.nullif(F.regexp_extract(first, r"[^\s<>;]+@[^\s<>;]+", 0), F.lit("")))


def date(value: Column) -> Column:
    """A date field as a timestamp; null where it isn't one."""
    text = F.regexp_replace(F.regexp_replace(value, r"\([^()]*\)", ""), r"^\s*[A-Za-z]+\s*,?", "")
    text = F.regexp_replace(F.btrim(F.regexp_replace(text, r"\s+", " ")), "(?i) (GMT|UTC|UT|Z)$", " +0000")
    for name, offset in ZONES.items():
        text = F.regexp_replace(text, f"(?i) {name}$", f" {offset}")
    text = F.initcap(F.lower(text))
    return F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm:ss Z")), F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm Z")))
