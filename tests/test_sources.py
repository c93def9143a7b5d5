"""Files, providers and operators beyond what the registered queries reach."""

import base64
import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import providers
from corpusflow.functions import text
from corpusflow.operators import chunks, enrich, evaluate, notebook, retrieval, semantic
from corpusflow.plans.slides import TEXTS
from corpusflow.sources import extraction, files


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_json_documents_there_and_back(spark, tmp_path):
    block = {"block_id": "a_p1_b2", "type": "text", "text": "é", "bbox": [0.0, 1.0, 2.0, 3.0], "reading_order": 2}
    first = {**block, "block_id": "a_p1_b1", "reading_order": 1}
    pages = [{"page_no": 1, "width": 10.0, "height": 20.0, "blocks": [first, block]}]
    path = tmp_path / "c" / "c_document.json"
    path.parent.mkdir()
    path.write_text(json.dumps({"course_id": "c", "documents": [{"doc_id": "a", "pages": pages}]}, indent=2))
    assert files.input_path(spark, str(tmp_path), "c") == str(path) and files.input_path(spark, str(tmp_path), "c", "x") == "x"
    blocks = files.blocks_of(files.read_json(spark, str(path), files.DOCUMENTS))
    assert [(r.block_id, r.page_width, r.text) for r in blocks.orderBy("reading_order").collect()] == [("a_p1_b1", 10.0, "é"), ("a_p1_b2", 10.0, "é")]
    out = str(tmp_path / "out")
    files.write_json(files.documents_of(blocks, course_id="c"), out, pretty=True)
    back = files.blocks_of(files.read_json(spark, out, files.DOCUMENTS))
    assert sorted(back.collect()) == sorted(blocks.collect())


def test_unsound_json_is_nothing(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": [1, ')
    (tmp_path / "good.json").write_text('{"a": 1}')
    read = lambda n: files.read_json_if_sound(spark, str(tmp_path / n), "a int").collect()
    assert read("bad.json") == [] == read("missing.json") and [r.a for r in read("good.json")] == [1]


def test_images_are_found_and_embedded(spark, tmp_path):
    root = str(tmp_path)
    for name in ("sub/b1.png", "b2.jpg", "figs/own.png", "sub/own.png"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(name.encode())
    images = files.image_files(spark, root)
    blocks = spark.createDataFrame([("b1", None), ("b2", "gone.png"), ("b3", "figs/own.png"), ("b4", "elsewhere/own.png"), ("b5", None)], "block_id string, image_path string")
    got = {r.block_id: r.path[len(root) + 1 :] for r in files.resolved_images(blocks, images, root).collect()}
    assert got == {"b1": "sub/b1.png", "b2": "b2.jpg", "b3": "figs/own.png", "b4": "figs/own.png"}
    urls = {r[0] for r in images.select(files.data_url(F.col("path"), F.col("content"))).collect()}
    assert "data:image/jpeg;base64," + base64.b64encode(b"b2.jpg").decode() in urls and len(urls) == 4


def test_index_and_vectors(spark, tmp_path):
    rows = [("atomic", "a", [3.0, 4.0], "x"), ("atomic", "b", [], "y"), ("semantic", "a", [1.0, 0.0], "z")]
    vectors = spark.createDataFrame(rows, "level string, id string, values array<double>, text string")
    files.write_index(vectors, str(tmp_path / "index"))
    found = files.load_index(spark, str(tmp_path / "index"), "atomic").collect()
    assert [(r.id, r.text) for r in found] == [("a", "x")] and found[0]["values"] == pytest.approx([0.6, 0.8])
    hits = spark.createDataFrame([(found[0].row_id, 1), (-1, 2), (10**15, 3)], "row_id long, rank int")
    assert [(r.id, r["rank"]) for r in files.with_items(hits, files.load_index(spark, str(tmp_path / "index"), "atomic")).collect()] == [("a", 1)]
    with pytest.raises(FileNotFoundError):
        files.load_index(spark, str(tmp_path / "index"), "none")
    with pytest.raises(ValueError):
        files.sound_vectors(vectors.filter("id = 'b'"))


def test_results_are_written_with_their_settings(spark, tmp_path):
    files.write_results(spark.createDataFrame([("b", 2), ("a", 1)], "id string, rank int"), str(tmp_path / "r"), "what?", top_k=5)
    told = json.loads("".join(p.read_text() for p in sorted((tmp_path / "r").glob("part*"))))
    assert told["query"] == "what?" and told["top_k"] == 5 and told["count"] == 2 and [r["id"] for r in told["results"]] == ["a", "b"]


def test_files_become_blocks(spark, tmp_path):
    (tmp_path / "C1-Intro.txt").write_text("# Head\nfirst line\n\nlast")
    (tmp_path / "skip.txt").write_text("no")
    pages = extraction.scan_files(spark, str(tmp_path), "c1", skip=("skip.txt",))
    got = extraction.blocks_from_items(pages).orderBy("reading_order").collect()
    assert [(r.block_id, r.type, r.text) for r in got] == [("c1_intro_p1_b1", "title", "Head"), ("c1_intro_p1_b2", "text", "first line"), ("c1_intro_p1_b3", "text", None), ("c1_intro_p1_b4", "text", "last")]
    assert pages.first().title == "Intro"


def test_items_of_a_layout_parser(spark):
    item = lambda kind, label, box, **more: {"kind": kind, "label": label, "bbox": box, **more}
    items = [
        item("picture", "picture", [0.0, 0.0, 10.0, 10.0], caption="small"), item("picture", "picture", [0.0, 100.0, 100.0, 20.0], caption=" a  plot ", bottom_left=True, image_path="x.png"),
        item("text", "section_header", [0.0, 0.0, 5.004, 5.0], text="Head"), item("text", "formula", [0.0] * 4, orig="y = 2", image_path="f.png"), item("table", "table", [0.0] * 4, markdown="a|b"), item("text", "list_item", [0.0] * 4, text="z"),
    ]
    pages = spark.createDataFrame([("d", 1, 200.0, 200.0, items)], f"doc_id string, {extraction.ITEMS}")
    got = {r.reading_order: r for r in extraction.blocks_from_items(pages).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6]
    assert (got[2].type, got[2].text, got[2].caption, got[2].image_path, got[2].bbox) == ("figure", None, "a plot", "x.png", [0.0, 100.0, 100.0, 180.0])
    assert (got[3].type, got[3].bbox[2]) == ("title", 5.0) and (got[4].type, got[4].text) == ("formula", "y = 2") and (got[5].type, got[5].text) == ("table", "a|b") and got[6].type == "text"
    flags = spark.createDataFrame([("Lecture.pdf",), ("Other.pdf",)], "n string").select(extraction.enriches_formulas(F.col("n"), True, ("Lecture.pdf",))).collect()
    assert [r[0] for r in flags] == [False, True]


def test_offline_vectors_and_answers(spark):
    df = spark.createDataFrame([(i, f"word{i} shared") for i in range(300)], "id int, t string")
    got = {r.id: r["values"] for r in providers.embedded(df, "t", batch=7).collect()}
    assert len(got) == 300 and all(np.dot(v, v) == pytest.approx(1) for v in got.values())
    assert got[5] == providers.hash_embedder()(["word5 shared"])[0]
    assert {r.answer for r in providers.answered(df, "t").collect()} == {None}
    with pytest.raises(RuntimeError):
        providers.require("no_such_library", "PATH")
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) % 2:
            raise OSError("down")
        return prompt.upper()

    assert providers.retried(flaky, 2)(["a", "b"]) == ["A", "B"] and providers.retried(lambda p: None)(["a"]) == [None]
    with pytest.raises(RuntimeError):
        providers.retried(lambda p: 1 / 0, 2, strict=True)(["a"])
    once = providers.Once(lambda: calls.append("built") or "model")
    assert once.get() == once.get() == ("model", None) and calls.count("built") == 1
    broken = providers.Once(lambda: 1 / 0)
    assert broken.get()[1].startswith("ZeroDivisionError")


def test_answers_of_models(spark):
    good = '```json\n{"formula_latex": "$$x$$", "formula_normalized": " the  loss ", "formula_explanation": "it falls", "overall_quality": "usable"}\n```'
    a, b = column(spark, [good, "no"], enrich.formula_answer)
    assert (a.formula_latex, a.formula_focus, a.formula_explanation, a.overall_quality) == ("x", "the loss", "it falls", "poor") and b is None


def test_escapes_and_nested_strings(spark):
    assert column(spark, ["a\\u00e9b", "plain é", "\\u12", None], text.decode_unicode_escapes) == ["aéb", "plain é", "\\u12", None]
    kind = T._parse_datatype_string("struct<a:string,b:array<struct<c:string,n:int>>,m:map<string,string>>")
    df = spark.createDataFrame([(("x\x07 y", [("\x00z", 1), None], {"k": "v\x1f"}),), (None,)], T.StructType([T.StructField("v", kind)]))
    got = [r[0] for r in df.select(text.strip_control_nested(F.col("v"), kind)).collect()]
    assert got[0].a == "x y" and got[0].b[0].c == "z" and got[0].b[1] is None and got[0].m == {"k": "v"} and got[1] is None


def plain_segments(t):
    marks = list(re.finditer(notebook.SEGMENT_MARK, t, re.IGNORECASE))
    if not marks:
        return None
    cuts = [0, *[m.start() for m in marks], len(t)] if marks[0].start() else [*[m.start() for m in marks], len(t)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        kind = "output" if a == 0 and marks[0].start() else "comment" if re.match(r"#\s+", t[a:b]) else "code"
        piece = " ".join(t[a:b].split())
        if not piece:
            continue
        if out and out[-1][0] == kind:
            gap = "" if out[-1][1][-1] in " '\"([{/." or piece[0] in ".,;:)]}" else " "
            out[-1] = (kind, out[-1][1] + gap + piece)
        else:
            out.append((kind, piece))
    return out


def test_code_segments(spark):
    cases = [t for t in TEXTS if t] + ["out 1 # note it x = 3 y = 4 import os.path print(x).item if a: b", "# a # b", "import a import b", "nothing here", "df = np. zeros"]
    got = column(spark, cases, notebook.code_segments)
    for t, g in zip(cases, got):
        want = plain_segments(t)
        assert [(s.kind, s.text) for s in g] == want if want else len(g) == 1 and g[0].text == t
    assert {s.kind for g in got for s in g} == {"output", "comment", "code"}


def plain_axis(s):
    number = r"[-+]?\d+(?:\.\d+)?"
    return any(re.fullmatch(p, s) for p in (r"-+", number + r"\s*-?", r"-\s*" + number, f"(?:{number}" + r"\s*){2,}", f"(?:{number}" + r"\s*-?\s*){2,}"))


def test_axis_numbers_in_linear_time(spark):
    cases = ["1", "1.5", "12.5.6", "1.5.6", "1.23.4", "1.2.3.4", "12.34.56.7", "5 - 3", "5--3", "5 -+3", "1 2 3", "-", "--", "- 5", "1.", "12.", "1..2", "7 x", "+1-2", "3-", "1.50 2.5-"]
    got = column(spark, cases, lambda c: c.rlike(rf"^(?:-+|-\s*{notebook.SIGNED}|{notebook.NUMBERS})$"))
    assert got == [plain_axis(c) for c in cases]
    long = column(spark, ["1" * 200_000 + "x", "1 " * 100_000 + "x"], notebook.is_axis_noise)
    assert long == [True, True]


def test_values_at_ranks(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=5000), np.repeat(0.25, 3000), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [0, 1, 17, 2500, 4000, 6001, len(values) - 1]
    assert semantic.values_at(df, "v", ranks, bins=64) == {r: v for r, v in zip(ranks, np.sort(values)[ranks])}


def test_levels_of_retrieval(spark):
    rng = np.random.default_rng(5)
    vectors = [(lv, i, rng.normal(size=8).tolist()) for lv in ("atomic", "semantic") for i in range(60)]
    own = spark.createDataFrame(vectors, "level string, id long, vector array<double>")
    asked = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(5)], "query long, vector array<double>")
    got = {}
    for r in retrieval.dense(own, asked, 3, per_block=16, queries_per_block=2).collect():
        got.setdefault((r.query, r.level), []).append((r["rank"], r.id))
    for q, v in [(r.query, np.array(r.vector)) for r in asked.collect()]:
        for lv in ("atomic", "semantic"):
            score = {i: float(v @ np.array(x) / np.linalg.norm(v) / np.linalg.norm(x)) for k, i, x in vectors if k == lv}
            assert [i for _, i in sorted(got[q, lv])] == sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]
    docs = spark.createDataFrame([("atomic", 1, ["a", "b"]), ("atomic", 2, ["b"]), ("semantic", 1, ["a"]), ("semantic", 3, ["c"])], "level string, id long, tokens array<string>")
    queries = spark.createDataFrame([(0, ["a"])], "query long, tokens array<string>")
    found = {(r.level, r.id): r.score for r in retrieval.bm25(docs, queries).collect()}
    assert set(found) == {("atomic", 1), ("semantic", 1)} and found["atomic", 1] != found["semantic", 1]
    fused = retrieval.hybrid(docs, own, queries, asked.filter("query = 0"), candidate_k=6, top_k=6).collect()
    assert len(fused) == 6 and {r.level for r in fused} == {"atomic", "semantic"} and any(r.bm25_rank for r in fused)
    items = spark.createDataFrame([("atomic", 1, ("d", 7, "text"), ("some words",)), ("semantic", 1, ("d", None, None), ("more",))], "level string, id long, metadata struct<doc_id:string,page_no:int,chunk_type:string>, document struct<text:string>")
    shown = {r.level: r for r in retrieval.output_fields(retrieval.hybrid(docs, own, queries, asked.filter("query = 0"), candidate_k=20, top_k=20), items).collect()}
    assert shown["atomic"].chunk_type == "text" and shown["semantic"].chunk_type == "semantic" and shown["atomic"].page_no == 7


def test_records_overwrite_by_null_where_the_field_is_there(spark):
    blocks = spark.createDataFrame([("d", 1, 1, "b1", "figure", "t", "old", "poor"), ("d", 1, 2, "b2", "figure", "t", "old", "poor")], "doc_id string, page_no int, reading_order int, block_id string, type string, text string, visual_description string, overall_quality string")
    records = spark.createDataFrame([("b1", 1, "new", "good", ["visual_description", "overall_quality"]), ("b1", 2, None, None, ["overall_quality"]), ("b2", 1, None, "good", ["visual_description", "overall_quality"])], "block_id string, record_no int, visual_description string, overall_quality string, present array<string>")
    got = {r.block_id: (r.visual_description, r.overall_quality, r.source) for r in chunks.merge_overlay(blocks, {"figure": records}).collect()}
    assert got == {"b1": ("old", None, "figure"), "b2": (None, "good", "figure")}


def test_cases_without_expectations_pass(spark):
    cases = evaluate.ad_hoc_cases(spark.createDataFrame([(1, "what?")], "number int, query string"))
    hits = spark.createDataFrame([("what?", "atomic", "hay", "text")], "query string, corpus string, haystack string, chunk_type string")
    assert [(r.query, r.passed) for r in evaluate.run_cases(cases, hits).collect()] == [("what?", True)] and cases.first().name == "custom-1"


def test_figures_are_attached_with_their_content(spark):
    words = "a plain text of more than six words"
    made = spark.createDataFrame([("d", 1, 1, 2, [1, 9], 80, words), ("d", 2, 3, 3, [1], 80, words), ("d", 3, 1, 1, [1], 10, words)], "doc_id string, ordinal long, first_page int, last_page int, block_nos array<int>, token_count long, content_for_embedding string")
    figures = spark.createDataFrame([("d", "f2", 1, 9, ("x",)), ("d", "f1", 2, 2, ("y",)), ("e", "f3", 1, 1, ("z",))], "doc_id string, chunk_id string, page_no int, block_no int, content_for_generation struct<figure_focus:string>")
    got = {r.ordinal: r for r in semantic.with_auxiliary(made, figures).collect()}
    assert got[1].auxiliary_chunk_ids == ["f2", "f1"] and got[1].auxiliary_chunks[0].content_for_generation.figure_focus == "x" and got[2].auxiliary_chunk_ids == []
