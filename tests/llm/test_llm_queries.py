import base64
import hashlib
import random
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import corpus_pipeline  # noqa: E402
from oracle import compare  # noqa: E402
from test_near_dup import brute as brute_components  # noqa: E402
from test_text_dedup import brute_lines  # noqa: E402

from ledgerspark.llm import queries, quality_classifier  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")


@here
@pytest.mark.parametrize("name", queries.ORACLES)
def test_equals_its_oracle(spark, name):
    compare(spark, FOLDER, queries.QUERIES[name], queries.ORACLES[name])


@here
def test_contract_columns(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    want = {
        "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
        "op8_pii": {"doc_id", "n_private", "text"},
        "op9_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, FOLDER)
        assert set(got.columns) == columns and got.count() == rows


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@here
def test_bpe_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    own = encoding()
    for r in queries.op9_bpe(spark, FOLDER).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, shared lines, nulls; labels."""
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("etaoins", k=rnd.randint(2, 7))) for _ in range(300)]
    lines = ["A line that many of the documents hold, number %d" % i for i in range(4)]
    docs = []
    for i in range(300):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randint(10, 120)))
        if i % 7 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 5 == 0 and docs:
            text = docs[-1][1] or text
        text += "\n" + "\n".join(rnd.sample(lines, rnd.randint(0, 3)))
        docs.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src2", None]), len(text)))
    docs += [(300, None, "en", "src0", None), (301, "", None, None, 0)]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"file://{out}/labels.parquet")
    return f"file://{out}"


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    columns = docs.columns

    def step(name, docs):
        got = stages[name](spark, docs, folder)
        return spark.createDataFrame(got.collect(), got.schema)

    first = step("quality classifier", docs)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.scorer()([(r.text or "").encode()])[0] >= 0.5}
    assert {r.doc_id for r in first.collect()} == want and 150 < len(want) < 290 and first.columns == columns

    second = step("line dedup", first)
    lines = brute_lines([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(((r.doc_id, r.text or "") for r in second.collect()), key=str) == [(i, t) for i, _, _, t in lines]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in second.collect()) and second.columns == columns

    third = step("minhash near-dedup", second)
    roots = brute_components([(r.doc_id, r.text) for r in second.collect()])
    assert {r.doc_id for r in third.collect()} == {i for i, c in roots.items() if i == c} and third.columns == columns

    fourth = step("mixing sources to target weights", third)
    from ledgerspark.llm import mixing

    words = {r.doc_id: (r.text or "", len((r.text or "").split())) for r in third.collect()}
    want = []
    for r in mixing.mix_sources(third, percent=corpus_pipeline.BUDGET_PERCENT).collect():
        text, n = words[r.doc_id]
        want += [(r.doc_id, text)] * (r.whole_epochs + (r.prefix_tokens == n > 0))
        if 0 < r.prefix_tokens < n:
            want.append((r.doc_id, re.match(r"([ \t-\r]*[^ \t-\r]+){%d}" % r.prefix_tokens, text)[0]))
    assert sorted((r.doc_id, r.text or "") for r in fourth.collect()) == sorted(want) and fourth.columns == columns
    assert any(t != words[i][0] for i, t in want) and all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in fourth.collect())

    fifth = step("byte-level BPE encoding and decoding", fourth)
    own = encoding()
    ids = sorted((r.doc_id, own.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in fourth.collect())
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in fifth.collect()) == ids and all(r.n_tokens == len(r.ids) for r in fifth.collect())


def test_the_mix_takes_every_document(spark):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en" if i % 3 else "de", "src1" if i % 2 else f"src{i % 7}", 9) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.mix(spark, frame, "").collect()} == set(range(400))


def test_the_mix_keeps_rows_without_an_id(spark):
    docs = [(i if i % 4 else None, f"a{i} b c", "en" if i % 3 else None, "src0" if i % 5 else None, i) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix(spark, frame, "")
    assert got.columns == frame.columns and set(docs) <= set(map(tuple, got.collect()))


def test_the_whole_pipeline_and_empty_documents(spark, folder, tmp_path):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 150 and whole.where(F.col("doc_id").isNull()).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
