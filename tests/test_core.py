import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions import vectors as V
from corpusflow.functions.geometry import Box
from corpusflow.operators import chunks, context, layout, retrieval, rules, semantic
from corpusflow.sources.adapters import blocks_from_documents


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_clean_text(spark):
    got = column(spark, [" a  b\t c ", "", " \u0085\x1c ", None, "x▶y"], T.clean_text)
    assert got == ["a b c", None, None, None, "x▶y"]
    assert column(spark, ["a▶b", None], T.clean_line) == ["a b", ""]


def test_sentences_slugs_and_counts(spark):
    assert column(spark, ["a , b .", "Figure 3: see this"], lambda c: T.normalize_sentence(c, figure_prefix=True)) == ["a, b.", "see this"]
    assert column(spark, ["--A b!C--", "", None], T.slugify) == ["a_b_c", "document", "document"]
    assert column(spark, ["a b c", "", None], T.token_count) == [3, 0, 0]
    assert column(spark, ["d1_p2_b17"], T.block_number) == [17]
    assert column(spark, ["a" * 300, "b", None], lambda c: F.length(T.compact(c))) == [260, 1, 0]


def test_formula_cleaning(spark):
    got = column(spark, ["L e a k y ( x )", "a _ 1 ^ 2", "\\ alpha"], T.clean_formula)
    assert got == ["Leaky (x)", "a_1^2", "\\alpha"]


def test_formula_quality(spark):
    cases = {"x = (1": "noisy", "{{": "truncated", "x =": "truncated", "": "truncated", None: "truncated", "&a": "truncated", "a b c d": "noisy", "x = 1": "good", "\\frac a": "noisy"}
    assert column(spark, list(cases), T.formula_quality) == list(cases.values())


def test_model_json(spark):
    got = column(spark, ['```json\n{"a": "x"}\n```', '{"a": "\\alpha"}', "no", "[1]"], lambda c: T.parse_model_json(c, "a string")["a"])
    assert got[0] == "x" and got[2:] == [None, None]
    assert got[1] == "\\alpha"


def test_latex_wrappers(spark):
    assert column(spark, ["$$a$$", "$b$", "\\[c\\]", "\\(d\\)", "e", "$$"], T.strip_latex)[:5] == ["a", "b", "c", "d", "e"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 5.0]), ([0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0.0, 0.0])
    half = spark.range(1).select(V.token_limit(F.lit(0.5), F.lit(0.0), F.lit(1.0), 400, 401)).first()[0]
    assert half == 400


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    a, b = Box.of(F.col("a")), Box.of(F.col("b"))
    got = df.select(a.common(b), a.overlap_ratio(b), a.horizontal_overlap(b), a.intersects(b), a.inside(b), b.inside(a, 5.0)).collect()
    assert tuple(got[0]) == (25.0, 0.25, 0.5, True, False, True)
    assert got[1][1] == 0.0


BLOCK = "doc_id long, page_no int, reading_order int, block_id string, type string, text string, bbox array<double>, page_width double, page_height double"


def page(spark, rows):
    return spark.createDataFrame([(1, 1, i + 1, f"d1_p1_b{i + 1}", k, t, b, 600.0, 800.0) for i, (k, t, b) in enumerate(rows)], BLOCK)


def test_columns_beside_a_figure(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    left, right = [10.0, 110.0, 90.0, 190.0], [510.0, 110.0, 590.0, 190.0]
    rows = [("figure", None, [100.0, 100.0, 500.0, 400.0]), ("text", words, left), ("text", words, [12.0, 200.0, 92.0, 300.0]), ("text", words, right), ("text", words, right)]
    assert {r[0] for r in layout.column_clusters(page(spark, rows)).select("block_id").collect()} == {f"d1_p1_b{i}" for i in (2, 3, 4, 5)}
    assert layout.column_clusters(page(spark, rows[:-1])).count() == 0


def test_fragments(spark):
    rows = [
        ("figure", None, [100.0, 100.0, 300.0, 300.0]), ("text", "axis label", [150.0, 150.0, 200.0, 170.0]),
        ("text", "Figure 2 shows the whole thing in detail for all of the readers", [100.0, 310.0, 300.0, 330.0]), ("text", "An ordinary sentence that stands far from it all.", [100.0, 600.0, 300.0, 630.0]),
        ("table", None, [100.0, 640.0, 300.0, 700.0]), ("text", "42.5", [100.0, 705.0, 130.0, 715.0]),
    ]
    kept = layout.drop_table_fragments(layout.drop_figure_fragments(page(spark, rows)))
    assert {r.block_id for r in kept.collect()} == {"d1_p1_b1", "d1_p1_b4", "d1_p1_b5"}


def test_rules(spark):
    cases = ["", None, "ab", "0.91/0.85", "This sentence explains what the model does in plain words.", "Table 3 lists", "a | 1 | 2", "GPT-3"]
    assert column(spark, cases, rules.is_obvious_noise) == [False, False, True, True, False, False, True, True]
    assert column(spark, cases, rules.is_caption) == [False, False, False, False, False, True, False, False]
    assert column(spark, cases, rules.is_table_fragment)[6:] == [False, True]


def test_titles_and_neighbours(spark):
    rows = [("text", "a text in front of the title", [0.0] * 4), ("title", "Head", [0.0] * 4), ("text", "too short", [0.0] * 4), ("text", "a text of sixteen and more", [0.0] * 4)]
    got = context.with_nearby_text(context.with_section_title(page(spark, rows))).orderBy("reading_order").collect()
    assert [r.section_title for r in got] == ["Head"] * 4
    assert got[3].nearby_text_before == "a text in front of the title" and got[0].nearby_text_after == "a text of sixteen and more"
    merged = context.with_merged_section_title(page(spark, rows)).collect()
    assert {r.section_title for r in merged} == {None}
    assert [r.block_id for r in context.renumbered(context.without_lead(page(spark, rows))).orderBy("reading_order").collect()] == ["d1_p1_b2", "d1_p1_b3", "d1_p1_b4"]


def test_bm25_against_a_plain_loop(spark):
    rng = random.Random(1)
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(0, 12))]) for i in range(30)]
    asked = [(0, ["a", "a", "b"]), (1, ["z"]), (2, ["c"])]
    got = {(r.query, r.id): r.score for r in retrieval.bm25(spark.createDataFrame(docs, "id long, tokens array<string>"), spark.createDataFrame(asked, "query long, tokens array<string>")).collect()}
    n, average = len(docs), sum(len(t) for _, t in docs) / len(docs)
    want = {}
    for q, terms in asked:
        for i, t in docs:
            s = 0.0
            for w in terms:
                df, tf = sum(w in u for _, u in docs), t.count(w)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / average)) if tf else 0.0
            if s > 0:
                want[q, i] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_dense_and_fusion(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = vectors.filter("id < 3").withColumnRenamed("id", "query")
    got = retrieval.dense(vectors, asked, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        assert [r.id for r in got.filter(F.col("query") == q).orderBy("rank").collect()] == np.argsort(-(unit @ unit[q]))[:5].tolist()
    fused = retrieval.fuse({"dense": got, "bm25": got.filter("id = 0")}).filter("query = 0 and id = 0").first()
    assert fused.combined_score == pytest.approx(2 / 61)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_overlay_and_chunks(spark):
    rows = [("title", "Head", [0.0] * 4), ("figure", "f", [0.0] * 4), ("formula", "x = 1", [0.0] * 4), ("text", "some text", [0.0] * 4), ("table", "t", [0.0] * 4), ("code", "c", [0.0] * 4)]
    record = lambda rows: spark.createDataFrame(rows, "block_id string, record_no int, overall_quality string, figure_focus string")
    figures = record([("d1_p1_b2", 1, "good", "old"), ("d1_p1_b2", 2, "poor", "new")])
    maths = record([("d1_p1_b4", 1, "broken", None), ("d1_p1_b3", 1, "good", None)])
    merged = chunks.merge_overlay(page(spark, rows), {"figure": figures, "text_inline_math": maths})
    assert {r.block_id: (r.type, r.source, r.figure_focus) for r in merged.collect()} == {
        "d1_p1_b1": ("title", "original", None), "d1_p1_b2": ("figure", "figure", "new"), "d1_p1_b3": ("formula", "original", None),
        "d1_p1_b4": ("text_inline_math", "text_inline_math", None), "d1_p1_b6": ("code", "original", None),
    }
    made = chunks.atomic_chunks(merged)
    assert {(r.chunk_id, r.indexable) for r in made.collect()} == {("d1_p1_b2_figure", False), ("d1_p1_b3_formula", False)}
    assert chunks.auxiliary(made).count() == 1
    assert tuple(chunks.skip_counts(merged).first()) == (1, 0, 1, 1)


def test_fold_and_thresholds(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 20, 0, i % 20, f"c{i:03d}", None, 150, "t", rng.normal(size=3).tolist()) for i in range(60)]
    schema = "doc_id long, page_no int, block_no int, chunk_id string, section_key string, token_count long, text string, embedding array<double>"
    records = spark.createDataFrame(rows, schema).repartition(3)
    got = semantic.semantic_chunks(records, -1.0, 0.5).orderBy("ordinal").collect()
    assert [c for r in got for c in r.chunk_ids] == [r[3] for r in rows]
    assert [r.ordinal for r in got] == list(range(1, len(got) + 1))
    assert all(r.token_count <= 800 and len({c for c in r.chunk_ids}) == len(r.merge_scores) + 1 for r in got)
    alone = semantic.fold_document(pd.DataFrame(rows[20:40], columns=[f.split(" ")[0] for f in schema.split(", ")]), -1.0, 0.5, 400, 800)
    assert [c["chunk_ids"] for c in alone] == [list(r.chunk_ids) for r in got if r.doc_id == 1]
    cuts = semantic.similarity_thresholds(semantic.adjacent_similarity(records)).first()
    values = [r.similarity for r in semantic.adjacent_similarity(records).collect()]
    assert cuts["threshold"] == pytest.approx(np.quantile(values, 0.45)) and cuts["n"] == 57
    empty = semantic.similarity_thresholds(semantic.adjacent_similarity(records.limit(0))).first()
    assert empty["threshold"] == 0.0


def test_fold_and_thresholds_take_one_pass(spark, monkeypatch):
    """A pandas group for each document, and the window anew for each cut of the histogram, took chunks_end_to_end beyond its time."""
    rows = [(None if i < 4 else i // 4, i % 2, None if i % 7 == 0 else i % 4, f"c{i:02d}", "s" if i % 3 else None, 100, "t", [1.0, i % 5 - 2.0]) for i in range(40)]
    schema = "doc_id long, page_no int, block_no int, chunk_id string, section_key string, token_count long, text string, embedding array<double>"
    records = spark.createDataFrame(rows, schema)
    kept, plans = semantic.stored, []
    monkeypatch.setattr(semantic, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    cuts = semantic.similarity_thresholds(semantic.adjacent_similarity(records)).first()
    assert cuts["n"] == 30 and sum("Window" in p for p in plans) == 1
    frame = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")]).fillna({"block_no": 9})
    records = spark.createDataFrame(rows, schema).fillna({"block_no": 9})
    got = semantic.semantic_chunks(records, -0.5, 0.5).collect()
    assert not any("InPandas" in p for p in plans)
    for d in range(1, 10):
        want = semantic.fold_document(frame[frame.doc_id == d], -0.5, 0.5, 400, 800)
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.ordinal)
        assert sorted((c["chunk_ids"], c["token_count"], c["last_page"]) for c in want) == sorted((list(r.chunk_ids), r.token_count, r.last_page) for r in own)


def test_classes_of_white_space_are_the_same_for_java(spark):
    signs = spark.range(0x110000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).filter("c <> ''")
    blank = F.col("c").rlike(T.WS)
    assert signs.filter((blank != F.col("c").rlike(T.BLANK)) | (blank == F.col("c").rlike(T.SOLID))).count() == 0
    odd = ["", " ", "  ", "a b", "a  b", "\ta\u00a0\u2003b \t", " \n", "\u3000", "a\tb", "a \n", None, "x " * 9, "x " * 8, " x" * 9, "x\u2028y z"]
    df = spark.createDataFrame([(t,) for t in odd], "c string")
    c = F.col("c")
    plain = F.trim(F.regexp_replace(c, T.WS + "+", " "))
    many = F.coalesce(F.regexp_count(c, F.lit(T.NOT_WS + "+")), F.lit(0))
    assert df.filter(~T.collapse(c).eqNullSafe(plain) | (T.token_count(c) != many) | (T.has_more_tokens(c, 8) != (many > 8))).count() == 0


def test_blocks_of_empty_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb")], "doc_id long, text string")
    assert blocks_from_documents(df).groupBy("doc_id").count().orderBy("doc_id").collect()[2]["count"] == 2


def test_entry_without_the_optional_package():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not re.search(r"\bllm\b", open(layout.__file__).read())


def test_notebook_profile(spark):
    from corpusflow.operators import notebook

    rows = [
        ("text", "In [3]: import pandas as pd", [0.0] * 4), ("text", "This is the mean of x = 3 in the data that we use.", [0.0] * 4), ("text", "0.5 1.0 1.5", [0.0] * 4),
        ("text", "Frequency", [0.0] * 4), ("formula", "x = ( 1 )", [0.0] * 4), ("formula", None, [0.0] * 4), ("text", "abc", [0.0] * 4),
    ]
    got = {r.block_id[-1]: (r.type, r.text, r.formula_quality, r.reading_order) for r in notebook.post_process(page(spark, rows)).collect()}
    assert got == {
        "1": ("code", "import pandas as pd", None, 1), "2": ("text", "This is the mean of x = 3 in the data that we use.", None, 2),
        "5": ("formula", "x = (1)", "good", 3), "6": ("formula", None, None, 4),
    }


def test_word_boundaries_are_those_of_the_sql(spark, tmp_path):
    from corpusflow.plans import catalog

    lines = ["Anètre la aiellet x = 3 y", "éin [3]: b c d e", "An x = 3 y z w", "the naïve éimport os", "aé def f(x) of b", "a b c d éis x = 3", "pd.é and ñpd.read x", "éOut [2]: 5 abc def"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(lines) * 16), pa.int64()), "text": ["\n".join(lines)] * len(lines) * 16}), tmp_path / "documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        for name in ("code_flags", "profile_notebook", "profile_deltas"):
            told = sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall())
            assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == told, name


def test_slide_profiles(spark):
    from corpusflow.operators import slides

    rows = [
        ("title", "Head", [0.0, 0.0, 100.0, 20.0]), ("figure", None, [100.0, 100.0, 300.0, 300.0]), ("text", "Columbia University", [100.0, 500.0, 300.0, 520.0]),
        ("text", "A sentence of content that stays wherever it is put.", [150.0, 150.0, 250.0, 200.0]), ("text", "-0.5", [90.0, 290.0, 99.0, 299.0]), ("formula", "y = 2", [100.0, 600.0, 200.0, 620.0]),
    ]
    papers = {r.block_id[-1] for r in slides.post_process_papers(page(spark, rows)).collect()}
    assert papers == {"1", "2", "6"}
    kept = slides.post_process_statistics(page(spark, rows), template=r"(?i)^columbia\s*university$").orderBy("reading_order").collect()
    assert [r.block_id[-1] for r in kept] == ["1", "2", "4", "6"] and [r.reading_order for r in kept] == [1, 2, 3, 4] and kept[3].formula_quality == "good"


def test_enrichment_rules(spark):
    from corpusflow.operators import enrich

    assert column(spark, ["Deep nets and deep nets about x", "the of", None], lambda c: F.array_join(enrich.keywords(c), "|")) == ["Deep nets and deep nets", "", ""]
    assert column(spark, ["gradient descent. Gradient descent! loss"], lambda c: F.array_join(enrich.keywords(c), "|")) == ["gradient descent|loss"]
    assert column(spark, ["x", "(a, b)", "1/0", "score 3", "2-4", "x^2 + y^2 = 1", "5 days"], enrich.is_trivial_span) == [True, True, True, True, True, False, True]
    assert column(spark, ["\\frac{a}{b}", "{", "\\zeta", None, ""], enrich.has_latex_errors) == [False, True, True, True, True]
    e = "an explanation that is long enough to be of use"
    assert column(spark, ["loss", "ab", "Head"], lambda c: enrich.usable_semantics(c, F.lit(e), F.lit("head"))) == [True, False, False]
    blocks = F.array(*[F.struct(F.lit("text").alias("type"), F.lit(t).alias("text")) for t in ("or", "first real sentence here.", "second real sentence here")])
    assert (spark.range(1).select(enrich.context_of(blocks, False)).first()[0]) == "first real sentence here second real sentence here"
