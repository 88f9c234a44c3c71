import base64
import hashlib
import quopri
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import mime
from ledgerspark.operators import signatures
from ledgerspark.sources import mail


def built(rnd, depth=0):
    """A random multipart body with its boundary, and where its leaves stand in it: (kind, bytes), cut by hand."""
    end = rnd.choice([b"\r\n", b"\n"])
    boundary = rnd.choice(["b", "b2", "=_a.b", "x y'z", "b--"]) + str(depth)
    out, leaves = rnd.choice([b"", b"preamble" + end, b"--" + end, b"--" + boundary.encode() + b"x" + end]), []
    for _ in range(rnd.randint(1, 3)):
        out += b"--" + boundary.encode() + rnd.choice([b"", b"  ", b"\t"]) + end
        if depth < 3 and rnd.random() < 0.35:
            inner, own, body = built(rnd, depth + 1)
            out += b"content-TYPE: Multipart/Mixed;" + end + b'\tcharset=x; BOUNDARY="' + inner.encode() + b'"' + end + end
            leaves += [(d, k, at + len(out), x) for d, k, at, x in own]
            out += body + end
            continue
        kind = rnd.choice(["text/plain", "message/rfc822", "image/png", None])
        body = b"".join(rnd.choice([b"a", b"\x85", b"\xc3\xa9", b"\r\n", b"\n", b"\n--", b"--b", b"\n--b0x", b"\n-- \n", b" ", b"\r\n\r\n", b"From: x\n\n"]) for _ in range(rnd.randint(0, 12)))
        out += (f"X-Long: {'y' * 200}".encode() + end + b" folded" + end if rnd.random() < 0.3 else b"") + (b"" if kind is None else b"Content-Type: " + kind.upper().encode() + b"; name=q" + end) + end
        leaves.append((depth + 1, kind or "text/plain", len(out), body))
        out += body + end
    closed = rnd.random() < 0.8 or depth == 0
    return boundary, leaves, out + (b"--" + boundary.encode() + b"--" + (end + b"epilogue" if rnd.random() < 0.5 else b"") if closed else b"")


def test_parts_equal_bytes_cut_by_hand(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for i in range(400):
        boundary, leaves, body = built(rnd)
        top = f'From: a@b\r\nContent-Type: multipart/mixed; boundary="{boundary}"\r\n\r\n'.encode()
        # a body that holds a delimiter by chance isn't one leaf
        if any(re.search(rb"(?:^|\n)--(?:b|b2|=_a\.b|x y'z|b--)\d(?:--)?[ \t]*(?:\r?\n|$)", x) for _, _, _, x in leaves):
            continue
        rows.append((i, top + body))
        want[i] = [(d, k, len(top) + at, len(top) + at + len(x)) for d, k, at, x in leaves]
    got = spark.createDataFrame(rows, "id int, content binary").select("id", "content", mime.parts(mime.latin(F.col("content"))).alias("p")).collect()
    assert len(rows) > 200 and any(len(v) > 4 for v in want.values()) and any(d > 2 for v in want.values() for d, *_ in v)
    for r in got:
        mine = [(p.depth, p.kind, p.start, p.stop) for p in r.p]
        # multiparts that aren't closed end with the one around them: the last leaf has the line breaks after theirs
        over = [bytes(r.content)[b[3] : a[3]] for a, b in zip(mine, want[r.id], strict=True)]
        assert [a[:3] for a in mine] == [b[:3] for b in want[r.id]] and not b"".join(over).strip(b"\r\n") and over.count(b"") >= len(over) - 3, r


ORIGINALS = {
    "crlf": b"From: A <a@x.example>\r\nSubject: " + b"long " * 60 + b"\r\n\ttail\r\nTo: p@x.example\r\n\r\nbody\r\n\r\n",
    "lf": b"From: a@x.example\nTo: p@x.example\n\nbody \n--x\n",
    "bytes": b"From: a@x.example\r\n\r\n" + bytes(range(256)) + b"\r\n.\r\n",
    "nested": b'From: a@x.example\r\nContent-Type: multipart/mixed; boundary="in"\r\n\r\n--in\r\nContent-Type: image/png\r\n\r\nP\r\n--in--\r\n',
    "empty": b"",
}
FORMS = {"8bit": lambda x: x, "base64": base64.encodebytes, "BASE64 ": lambda x: base64.b64encode(x).replace(b"=", b""), "quoted-printable": quopri.encodestring, "7bit": lambda x: x}


def wrapped(original, encoding):
    return b"".join((
        b'From: "X, Y" <P@x.example>\r\nContent-Type: multipart/mixed; boundary="out"\r\n\r\n--out\r\n\r\nhi\r\n--out\r\nContent-Type: message/rfc822\r\nContent-Transfer-Encoding: ', encoding.encode(), b"\r\n\r\n",
        FORMS[encoding](original), b"\r\n--out\r\nContent-Type: message/rfc822\r\n\r\nanother\r\n--out--\r\n",
    ))


def test_originals_are_kept_byte_for_byte(spark):
    cases = [(n, e) for n in ORIGINALS for e in FORMS if e != "quoted-printable" or n not in ("lf", "bytes")]
    rows = spark.createDataFrame([(n, e, wrapped(ORIGINALS[n], e)) for n, e in cases], "name string, encoding string, content binary")
    got = mail.parse_messages(rows).collect()
    for r in got:
        assert bytes(r.mail.original) == ORIGINALS[r.name], (r.name, r.encoding)
        assert r.content_hash == hashlib.sha256(ORIGINALS[r.name]).hexdigest() and not r.mail.has_image and r.mail.from_addr == "P@x.example"
    assert len(got) == len(cases) and {r.mail.to_addr for r in got if r.name == "crlf"} == {"p@x.example"}
    assert {r.mail.subject for r in got if r.name == "crlf"} == {("long " * 60 + "\ttail")}


def test_quoted_printable(spark):
    texts = {b"a=20b": b"a b", b"a=\r\nb": b"ab", b"a =\nb  \r\nc\t\n": b"a b\r\nc\n", b"=zz=C3=a9=": b"=zz\xc3\xa9", b"": b"", b"=3D3D": b"=3D", b"x=\t\r\ny": b"xy"}
    rows = spark.createDataFrame([(k,) for k in texts], "t binary")
    assert {bytes(r.t): bytes(r.d) for r in rows.select("t", mime.decoded(F.col("t"), F.lit("Quoted-Printable")).alias("d")).collect()} == texts


def test_header_fields(spark):
    cases = {
        "address": [("A <A@x.y>", "A@x.y"), ('"a <b@c>, d" <e@F>', "e@F"), ("x@y, B <b@c>", "x@y"), ("Group: m@n, o@p;", "m@n"), ("nobody", None), ("(c@d) e@f (g)", "e@f"), ("", None)],
        "words": [("=?UTF-8?Q?a=5Fb_=C3=A9?=", "a_b é"), ("=?utf-8?b?w6k=?= =?utf-8?b?w6k=?= x", "éé x"), ("=?iso-8859-1?q?=E9?= =?koi8-r?q?=E9?=", "é=?koi8-r?q?=E9?="), ("a =? b", "a =? b"), ("\xc3\xa9", "é"), ("\xe9", "\xe9"), ("", "")],
        "date": [
            ("Tue, 15 Sep 2026 12:00:00 +0000", datetime(2026, 9, 15, 12)), ("5 SEP 2026 9:05 -0130 (x)", datetime(2026, 9, 5, 10, 35)), ("Tue,  15 Sep 2026\t12:00:00 GMT", datetime(2026, 9, 15, 12)),
            ("15 Sep 2026 12:00:00 EST", datetime(2026, 9, 15, 17)), ("yesterday", None), ("31 Feb 2026 00:00:00 +0000", None), ("", None),
        ],
    }
    for name, pairs in cases.items():
        rows = spark.createDataFrame([(*p,) for p in pairs], f"x string, want {'timestamp' if name == 'date' else 'string'}")
        for r in rows.select("x", "want", getattr(mime, name)(F.col("x")).alias("got")).collect():
            assert r.got == r.want, (name, r)


def test_odd_messages(spark):
    cases = {
        1: (b"From: a@b\nContent-Type: multipart/digest; boundary=d\n\n--d\n\nSubject: one\n\n--d\nContent-Type: text/plain\n\ntwo", [("message/rfc822", b"Subject: one\n"), ("text/plain", b"two")]),
        2: (b"Content-Type: multipart/mixed\n\n--x\n\na\n--x--", [("multipart/mixed", b"--x\n\na\n--x--")]),
        3: (b"\n--b\n", [("text/plain", b"--b\n")]),
        4: (b"Content-Type: multipart/mixed; boundary=b\n\n--b--\nafter", []),
        5: (b"Content-Type: multipart/mixed; boundary=b\n\n--b\nX: y\n--b\n\n\n--b--", [("text/plain", b""), ("text/plain", b"")]),
        6: (b"no header at all", [("text/plain", b"")]),
        7: (b"X: \x85Content-Type: image/png\nContent-Type: text/HTML;x=\"a;boundary=q\"\n\nx", [("text/html", b"x")]),
    }
    rows = spark.createDataFrame([(i, c) for i, (c, _) in cases.items()] + [(9, None)], "id int, content binary")
    for r in rows.select("id", "content", mime.parts(mime.latin(F.col("content"))).alias("p")).collect():
        if r.id == 9:
            assert r.p is None
            continue
        assert [(p.kind, bytes(r.content)[p.start : p.stop]) for p in r.p] == cases[r.id][1], r.id


# --- signatures, made by plain Python


def prime(rnd, bits):
    while True:
        n = rnd.getrandbits(bits) | 1 << (bits - 1) | 1 << (bits - 2) | 1
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)) and (n - 1) % 65537:
            return n


def der(kind, body):
    size = len(body)
    return bytes([kind]) + (bytes([size]) if size < 128 else bytes([128 + (len(f"{size:x}") + 1) // 2]) + size.to_bytes((len(f"{size:x}") + 1) // 2, "big")) + body


def key_pair(bits, seed):
    rnd = random.Random(seed)
    p, q = prime(rnd, bits // 2), prime(rnd, bits // 2)
    whole = lambda n: der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))
    bare = der(0x30, whole(p * q) + whole(65537))
    info = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d010101") + b"\x05\x00") + der(3, b"\0" + bare))
    return p * q, pow(65537, -1, (p - 1) * (q - 1)), base64.b64encode(info).decode(), base64.b64encode(bare).decode()


def signed(message, key, form="relaxed/relaxed", names="from:to:subject:date", selector="s", domain="casino.example", algorithm="rsa-sha256", length=None, more=""):
    head, _, body = message.partition(b"\r\n\r\n")
    listed = re.split(rb"\r\n(?![ \t])", head)
    a, _, b = form.partition("/")
    if b == "relaxed":
        lines = [re.sub(rb"[ \t]+", b" ", x).rstrip(b" ") for x in body.split(b"\r\n")]
    else:
        lines = body.split(b"\r\n")
    while lines and not lines[-1]:
        lines.pop()
    body = b"\r\n".join(lines) + b"\r\n" if lines or b != "relaxed" else b""
    digest = hashlib.sha1 if algorithm.endswith("sha1") else hashlib.sha256
    body = body if length is None else body[:length]

    def canon(line):
        if a != "relaxed":
            return line
        name, _, value = line.partition(b":")
        return name.strip().lower() + b":" + re.sub(rb"[ \t]+", b" ", value.replace(b"\r\n", b"")).strip()

    left, what = list(listed), b""
    for name in names.split(":"):
        own = [k for k, x in enumerate(left) if x is not None and x.partition(b":")[0].strip().lower() == name.strip().lower().encode()]
        if own:
            what += canon(left[own[-1]]) + b"\r\n"
            left[own[-1]] = None
    limit = "" if length is None else f" l={length};"
    own = f"DKIM-Signature: v=1; a={algorithm}; c={form}; d={domain};\r\n\ts={selector}; h={names};{limit}{more}\r\n bh={base64.b64encode(digest(body).digest()).decode()};\r\n b=".encode()
    inner = bytes.fromhex(signatures.PREFIX[algorithm]) + digest(what + canon(own)).digest()
    size = (key[0].bit_length() + 7) // 8
    number = pow(int.from_bytes(b"\0\1" + b"\xff" * (size - len(inner) - 3) + b"\0" + inner, "big"), key[1], key[0])
    text = base64.b64encode(number.to_bytes(size, "big"))
    return own + text[:60] + b"\r\n\t" + text[60:] + b"\r\n" + message


@pytest.fixture(scope="module")
def keys():
    return key_pair(1024, 1), key_pair(2048, 2), key_pair(512, 3)


MESSAGE = b"From: No <no-reply@casino.example>\r\nTo:  p@x.example\r\nSubject: Wel \t come\r\n  to  you\r\nDate: Tue, 15 Sep 2026 12:00:00 +0000\r\nReceived: one\r\nReceived: two\r\n\r\nThanks  for \t signing up. \r\n\xc3\xa9\x85\r\n\r\n\r\n"


def results(spark, messages, records, **more):
    rows = spark.createDataFrame(list(messages.items()), "name string, original binary").withColumn("dkim", F.lit("x"))
    table = spark.createDataFrame(records, "selector string, domain string, key string")
    return {r.name: r for r in signatures.verify(rows, table, **more).collect()}


def test_signatures_that_pass_and_one_changed_byte(spark, keys):
    one, two, _ = keys
    good = {}
    for form in ("relaxed/relaxed", "simple/simple", "relaxed/simple", "simple/relaxed", "relaxed", "simple"):
        good[form] = signed(MESSAGE, one, form)
    good["bits"] = signed(MESSAGE, two, selector="long")
    good["old"] = signed(MESSAGE, one, algorithm="rsa-sha1")
    good["again"] = signed(MESSAGE, one, names="from:From:received:Received:received:subject:none")
    good["no body"] = signed(MESSAGE.partition(b"\r\n\r\n")[0] + b"\r\n\r\n", one)
    good["no body simple"] = signed(MESSAGE.partition(b"\r\n\r\n")[0] + b"\r\n\r\n", one, "simple/simple")
    good["limit"] = signed(MESSAGE, one, length=10)
    records = [("s", "Casino.example", f"v=DKIM1; k=rsa; p={one[2]}"), ("long", "casino.example", two[3])]
    got = results(spark, good, records)
    assert {n: r.dkim for n, r in got.items()} == dict.fromkeys(good, "pass")
    assert {r.l_tag_present for n, r in got.items() if n != "limit"} == {False} and got["limit"].l_tag_present
    assert got["bits"].public_key == two[3] and got["old"].public_key == one[2] and {r.d_domain for r in got.values()} == {"casino.example"} and got["bits"].selector == "long"
    # what the relaxed form lets pass, and what it doesn't
    base = good["relaxed/relaxed"]
    changed = {
        "spaces": base.replace(b"Thanks  for", b"Thanks for"), "folds": base.replace(b"\r\n  to  you", b" to you"), "end": base + b"\r\n", "case": base.replace(b"Subject:", b"SUBJECT:"), "added": good["limit"] + b"more",
        "unsigned": base.replace(b"Received: one", b"Received: three"), "lf": good["relaxed/relaxed"].replace(b"\r\n", b"\n"),
    }
    assert {n: r.dkim for n, r in results(spark, changed, records).items()} == dict.fromkeys(changed, "pass")
    bad = {
        "body": base.replace(b"signing", b"singing"), "to": base.replace(b"p@x", b"q@x"), "date": base.replace(b"2026", b"2027"), "simple": good["simple/simple"].replace(b"Thanks  for", b"Thanks for"),
        "b": base.replace(b"\r\n b=", b"\r\n b=A"), "second from": base.replace(b"\r\n\r\n", b"\r\nFrom: e@vil\r\n\r\n", 1), "added": good["limit"].replace(b"Thanks", b"thanks"),
    }
    assert {n: signed_ for n, signed_ in {n: r.dkim for n, r in results(spark, bad, records).items()}.items() if signed_ not in ("fail", "neutral")} == {}


def test_signatures_without_a_verdict(spark, keys):
    one, two, short = keys
    base = signed(MESSAGE, one)
    cases = {
        "none": (MESSAGE, "none"), "null": (None, "none"), "no key": (signed(MESSAGE, one, selector="other"), "neutral"), "lost": (signed(MESSAGE, one, selector="lost"), "temperror"), "withdrawn": (signed(MESSAGE, one, selector="gone"), "neutral"),
        "garbage": (signed(MESSAGE, one, selector="bad"), "neutral"), "short": (signed(MESSAGE, short, selector="short"), "policy"), "algorithm": (base.replace(b"a=rsa-sha256", b"a=ed25519-sha256"), "permerror"),
        "no h": (base.replace(b"h=from", b"g=from"), "permerror"), "other key": (signed(MESSAGE, one, selector="two"), "fail"), "first counts": (base.replace(b"b=", b"b=AA", 1) + b"", "neutral"), "late": (signed(MESSAGE, one, more=" x=1000;"), "policy"),
        "in time": (signed(MESSAGE, one, more=" x=4000000000;"), "pass"), "kind": (signed(MESSAGE, one, selector="ed"), "neutral"), "two": (signed(base, one), "pass"),
    }
    records = [("s", one[2]), ("lost", None), ("gone", "v=DKIM1; p="), ("bad", "v=DKIM1; p=AAAA"), ("short", short[2]), ("two", two[2]), ("ed", f"k=ed25519; p={one[2]}"), (None, one[2]), ("s", "zzz")]
    got = results(spark, {n: m for n, (m, _) in cases.items()}, [(s, "casino.example", k) for s, k in records], now=datetime(2026, 1, 1))
    assert {n: got[n].dkim for n, (_, want) in cases.items() if n != "first counts"} == {n: w for n, (_, w) in cases.items() if n != "first counts"}
    assert got["none"].selector is None and not got["null"].l_tag_present and results(spark, {}, []) == {}
