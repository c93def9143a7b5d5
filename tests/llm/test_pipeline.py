"""The pipeline's stages against plain Python on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm.common import stored

from test_operators import components, leaks

WORDS = {
    "xx": [a + b for a in ("ka", "mi", "tun", "ve", "lo") for b in ("lo", "ra", "do", "lis", "nar", "te")],
    "yy": [a + b for a in ("schr", "gr", "pfl", "wr", "kn") for b in ("op", "utz", "ing", "ack", "elb", "orst")],
}
FOREIGN = [a + b for a in ("zhq", "qx", "jjv") for b in ("ooyo", "eeye", "uuwu", "aaya")]
SECRET = "password=Zk3mP0vLx92TtYb4"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    item = [rng.choice(WORDS["xx"]) + str(i) for i in range(14)]
    docs = []

    def add(words, lang, kind):
        docs.append((len(docs), None if words is None else " ".join(words), lang, "web", 0, kind, "other"))

    for _ in range(260):
        lang = rng.choice(["xx", "yy"])
        add([rng.choice(WORDS[lang]) for _ in range(110)], lang, "clean")
    for i in range(0, 30, 3):
        add(docs[i][1].split(), docs[i][2], "copy")
        near = docs[i + 1][1].split()
        near[50] = "kalo"
        add(near, docs[i + 1][2], "near copy")
    for i in range(6):
        add([rng.choice(WORDS["xx"]) for _ in range(100)] + item[: 9 + i] + ["kalo"], "xx", "leak" if i else "short of a leak")
    for _ in range(5):
        add([rng.choice(WORDS["yy"]) for _ in range(100)] + [SECRET, "grop"], "yy", "secret")
    for _ in range(8):
        add([rng.choice(FOREIGN) for _ in range(110)], None, "foreign")
    add(None, None, "null")
    add(["123", "456"], None, "no letters")
    d = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kind string, mix_rate string")
    df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(docs[i][2] == "xx"), 0) for i in range(260) if i % 9], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, item


def test_stages_equal_plain_versions(spark, corpus):
    d, docs, item = corpus
    text = {r[0]: r[1] for r in docs}
    made, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = made.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, made, d))
        rows = {r.doc_id: r for r in made.collect()}
        seen.append(rows)
        assert made.columns[: len(columns)] == columns and len(rows) == made.count()
    known, single, clean, safe, mixed = seen
    assert set(known) == {r[0] for r in docs if r[5] not in ("foreign", "null", "no letters")}
    order = sorted(known)
    named = components([text[i] for i in order])
    assert set(single) == {order[n] for _, n in named.values()}
    hit = leaks([(i, text[i]) for i in single], [(1, " ".join(item))])
    assert set(clean) == {i for i in single if not hit[i][1]} and any(docs[i][5] == "short of a leak" for i in clean)
    want = {i: text[i].replace(SECRET, "[SECRET:assign]") for i in clean}
    assert {i: r.text for i, r in safe.items()} == want and sum("[SECRET" in t for t in want.values()) == 5
    assert all(r.n_chars == len(r.text) for r in safe.values())
    assert set(mixed) == set(safe) and {i: r.mix_n_tokens for i, r in mixed.items()} == {i: len(t.split()) for i, t in want.items()}
    plain = {i: r for i, r in mixed.items() if docs[i][2] == "xx"}
    assert all(r.mix_domain == ("plain" if i in plain else "low") for i, r in mixed.items())
    tokens = sum(r.mix_n_tokens for r in mixed.values())
    share = sum(r.mix_n_tokens * r._mix_rate for r in plain.values()) / tokens
    assert share == pytest.approx(0.97 / 0.99, abs=0.01) and min(r._mix_rate for r in mixed.values()) >= 0


def test_run_gives_the_last_stage(spark, corpus):
    d, docs, _ = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    assert len(rows) == len({r.doc_id for r in rows}) > 100 and {"mix_n_tokens", "mix_domain", "_mix_rate"} <= set(rows[0].asDict())


def test_empty_table(spark, corpus, tmp_path):
    d, _, _ = corpus
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
