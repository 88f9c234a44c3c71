import base64
import gzip
import hashlib
import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import centroids, filter_audit, warc
from ledgerspark.llm.storage import Scratch


def brute_audit(docs, labels):
    conditions = {
        "A": lambda w, t: len(w) < 100, "B": lambda w, t: 100 * len(set(w)) < 80 * len(w),
        "C": lambda w, t: 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": lambda w, t: any(c in "#$%&*|" for c in t),
    }
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {k for k, f in conditions.items() if f(w, text)}
        if i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_corpus():
    rnd = random.Random(3)
    docs = []
    for i in range(160):
        n = rnd.choice([0, 3, 99, 100, 101, 150])
        text = rnd.choice([" ", "\n", "\x0b ", "\x85", " "]).join(rnd.choice(["word", "W" * 8, f"w{rnd.randrange(10**6)}", "Überé", "a#b"] if rnd.random() < 0.2 else [f"x{rnd.randrange(200)}", "yy"]) for _ in range(n))
        docs.append((i, rnd.choice(["", " "]) + text, rnd.choice(["en", "de", "", None])))
    docs += [(200 + i, rnd.choice(docs)[1], rnd.choice(["en", "fr"])) for i in range(40)]
    docs += [docs[0], docs[0], (3, "other text", "en"), (None, docs[1][1], "en"), (None, None, None), (500, None, "en"), (501, "", "en"), (-5, docs[7][1], "de")]
    docs += [(600, "%s " % ("lorem ipsum " * 30000), "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_corpus()
    rows = spark.createDataFrame([(i, t, x, 1, "e", b"d") for i, t, x in docs], "doc_id long, text string, lang string, n int, part string, digest binary")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(rows, marks)
    assert got.dtypes[2] == ("step", "int") and all(kind == "bigint" for _, kind in got.dtypes[3:])
    got = got.collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == brute_audit(docs, labels) and len(got) == 600 * len({x or "" for _, _, x in docs})


def test_audit_of_other_filters_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, None, "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(rows, marks, {"x": F.col("text") == "a", "y": F.col("doc_id") > 1}, copies=None, part=F.lit(7)).collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in got) == [("7", "xy", 1, 3, 1, 2), ("7", "xy", 2, 0, 3, 6), ("7", "yx", 1, 1, 3, 6), ("7", "yx", 2, 0, 1, 2)]
    assert filter_audit.audit(rows.limit(0), marks).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(rows, marks, {"E": F.lit(True)})


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_orders_differ_by_one_swap(k):
    seen, before = set(), None
    for order, at in filter_audit.orders(k):
        if before:
            assert before[:at] + [before[at + 1], before[at]] + before[at + 2 :] == order
        before = list(order)
        seen.add(tuple(order))
    assert len(seen) == math.factorial(k)


def brute_clusters(rows, clusters, rounds, dimension):
    from fractions import Fraction

    kept = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [list(v) for _, v in ranked[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(now)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == k]
            if mine:
                now[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [near(v) for _, v in kept]
    cap = lambda x: min(x, 2**63 - 1)
    per = {k: sum(cap(d) for d, c in found if c == k) for k in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, cap(d), cap(per[c]), cap(sum(per.values())), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def vectors(kind, dimension):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), rnd.randint(-1, 1) / 256]) for _ in range(dimension)]) for i in range(300)]
    if kind == "ties":
        rows = [(i, [rnd.randint(0, 3) / 256 for _ in range(dimension)]) for i in range(300)]
    if kind == "large":
        rows += [(400 + i, [rnd.choice([-1, 1]) * 10.0 ** rnd.choice([0, 6, 12, 40, 200, 307]) for _ in range(dimension)]) for i in range(40)]
    rows += [rows[0], rows[0], (7, rows[8][1]), (None, rows[9][1]), (None, [0.5] * dimension)]
    return rows + [(900, None), (901, [1.0] * (dimension - 1)), (902, [math.nan] * dimension), (903, [None] + [1.0] * (dimension - 1)), (904, [math.inf] + [1.0] * (dimension - 1)), (905, [])]


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vectors(kind, 4)
    frame = spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, embedding array<double>, cluster int, upper string")
    got = centroids.cluster(frame, clusters=12, rounds=4, dimension=4, bounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 12, 4, 4)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.cluster(frame, dimension=2).collect()), key=str) == brute_clusters(rows, 40, 5, 2)
    assert centroids.cluster(frame.limit(0), dimension=2).collect() == [] and centroids.cluster(frame).collect() == []


def test_bounds_save_work_and_lose_nothing():
    rnd = np.random.default_rng(1)
    v = rnd.integers(-300, 300, (3000, 8)) + rnd.integers(-3, 3, (20, 8))[rnd.integers(0, 20, 3000)] * 900
    now = centroids.Centroids(v[:24].tolist())
    part = centroids.Part(v, np.zeros(3000, np.int32), np.zeros(3000), np.zeros((3000, 5), "<u2"), np.zeros((3000, 5)), np.zeros(3000))
    part.scan(np.arange(3000), now)
    for _ in range(12):
        rows = [(v[part.cluster == c].sum(axis=0) // max(1, (part.cluster == c).sum())).tolist() if (part.cluster == c).any() else now.rows[c] for c in range(24)]
        now = now.next(rows)
        part.reassign(now)
        part.measure(now)
        d = now.to_all(v)
        assert (part.cluster == d.argmin(axis=1)).all() and (part.distance == d.min(axis=1)).all()
    assert part.all < 3000 * 6 and part.some > 0


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute_pages(pages, least=0):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        late = len(data) >= least and bool(ids) and (i is None or i > min(ids))
        out.append((i, len(data), sha1(data), "revisit" if late else "response", min(ids) if late else None))
    return sorted(out, key=str)


def some_pages():
    rnd = random.Random(2)
    body = lambda: "".join(rnd.choices("abc <p>é中\r\n", k=rnd.choice([0, 1, 20, 300, 5000])))
    pages = [(i, f"http://h{i % 7}/a b\r\nX: {i}é", body()) for i in range(60)]
    pages += [(100 + i, rnd.choice(["http://x/", None]), rnd.choice(pages)[2]) for i in range(40)]
    pages += [pages[3], (3, "http://other/", pages[3][2]), (None, "n", pages[3][2]), (None, None, "alone"), (None, None, "alone"), (200, "u", None), (201, "u", ""), (-4, "u", "WARC/1.1\r\n\r\n")]
    return pages + [(300, "long", "x" * 3_000_000 + "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200_000)))]


@pytest.mark.parametrize(("least", "file_bytes", "range_bytes"), [(0, 1 << 28, 1 << 26), (2, 5000, 700), (25, 1, 4096)])
def test_pages_there_and_back(spark, tmp_path, least, file_bytes, range_bytes):
    pages = some_pages()
    frame = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, payload int, key string")
    got = warc.archived_pages(frame, least, f"file://{tmp_path}/a", file_bytes, range_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_pages(pages, least)
    files = list(Path(f"{tmp_path}/a").glob("*.warc.gz"))
    assert len(files) > (60 if file_bytes < 5000 else 0)
    texts = [gzip.decompress(f.read_bytes()) for f in files]  # a whole file is one gzip stream too
    assert sum(t.count(b"\r\nWARC-Target-URI: ") for t in texts) == sum(p[1] is not None for p in pages) and all(t.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for t in texts)
    listed = warc.read_archives(warc.archive_files(spark, f"file://{tmp_path}/a"), range_bytes)
    rows = listed.where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in rows} == {(h or "").encode() for _, _, h in pages} and all(sha1(bytes(r.payload)) == r.payload_digest for r in rows)


def test_no_pages(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(frame, folder=f"file://{tmp_path}/a").collect() == []


def inner_archive(n, rnd):
    return b"".join(warc.record("resource", {"WARC-Record-ID": f"<urn:in:{i}>"}, rnd.randbytes(150)) for i in range(n))


def test_archives_inside_archives(spark, tmp_path):
    """A record whose payload is an archive, stored as it is: ranges that start within it must not take its members for records."""
    rnd = random.Random(4)
    outer = [warc.record("resource", {"WARC-Record-ID": f"<urn:out:{i}>"}, rnd.randbytes(40) + (inner_archive(60, rnd) if i % 3 == 1 else b"") + rnd.randbytes(900)) for i in range(9)]
    outer = [gzip.compress(gzip.decompress(x), 0, mtime=0) for x in outer]  # not compressed
    (tmp_path / "x.warc.gz").write_bytes(b"".join(outer))
    assert outer[1].count(warc.MAGIC) > 30
    scratch = Scratch(spark)
    files = warc.archive_files(spark, f"file://{tmp_path}")
    for size in (997, 5000, 1 << 20):
        marks = warc.marked(files, scratch, size).collect()
        places = [sum(map(len, outer[:i])) for i in range(9)]
        assert sorted(m.entry for m in marks if m.entry is not None) == sorted({min(p for p in places if p // size == k) for k in {p // size for p in places}})
        got = warc.read_archives(files, size).collect()
        assert sorted((r.offset, r.record_id) for r in got) == [(p, f"urn:out:{i}") for i, p in enumerate(places)]


def test_damage_is_told_and_loses_one_record(spark, tmp_path):
    rnd = random.Random(9)
    parts = [warc.record("resource", {"WARC-Record-ID": f"<urn:r:{i}>"}, rnd.randbytes(500)) for i in range(20)]
    data = bytearray(b"".join(parts))
    data[sum(map(len, parts[:7])) + 300] ^= 255
    (tmp_path / "x.warc.gz").write_bytes(bytes(data) + b"tail")
    files = warc.archive_files(spark, f"file://{tmp_path}")
    for size in (1000, 1 << 20):
        with pytest.raises(ValueError, match="belong to no record"):
            warc.read_archives(files, size)
        got = warc.read_archives(files, size, strict=False).collect()
        assert {r.record_id for r in got} == {f"urn:r:{i}" for i in range(20) if i != 7} and len(got) == 19
    wrong = warc.record("response", {"WARC-Payload-Digest": "sha1:" + sha1(b"other"), "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "x.warc.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(files := warc.archive_files(spark, f"file://{tmp_path}")).collect()
    assert files.count() == 1
