"""Core operators on handmade cases, with plain-Python statements of the rules beside them."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone import cli
from inkstone.functions import text as X
from inkstone.functions.glyphs import fold
from inkstone.functions.vectors import l2_normalize
from inkstone.operators import catalog, chunking, layout, retrieval, tables, units
from inkstone.plans import layout_queries
from inkstone.sources import files
from inkstone.streaming import pages as stream

CELL = "array<struct<row:int,col:int,text:string,bbox:array<double>,is_header:boolean,row_span:int,col_span:int,text_box_ids:array<string>>>"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0    　"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


# --- text


def normal(t):
    t = re.sub(r"[ \t]+", " ", t.replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_normalize_on_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(BLANKS + "ab中。​🙂") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", X.normalize_whitespace(F.col("c")).alias("x")).collect()
    assert all(r.x == normal(texts[r.k]) for r in got)


@pytest.mark.parametrize("text,expected", [("BYD_202601.pdf", "byd_202601"), ("...", "document"), ("  A  b--c.7z", "a_b_c"), ("", "document"), ("比亚迪 年报", "比亚迪_年报")])
def test_stable_id(spark, text, expected):
    assert one(spark, text, X.stable_id) == expected


def test_preview_and_escape(spark):
    assert one(spark, "abcdefghijkl", lambda c: X.preview(c, 10)) == "abcdefg..."
    assert one(spark, "abc\ndef", lambda c: X.preview(c, 10)) == "abc def"
    assert one(spark, "<a & 'b'>\"", X.html_escape) == "&lt;a &amp; &#x27;b&#x27;&gt;&quot;"
    assert one(spark, None, X.normalize_whitespace) is None


@pytest.mark.parametrize("text,flags", [("1,234", "np"), ("(3.5)", "np"), ("2024E", "np"), ("—", "p"), ("abc", ""), ("", ""), ("%", ""), ("12a45", "n"), ("1a", ""), ("２０２４", "np"), ("3/10", "ng"), ("第3页共10页", "g"), ("-3-", "ng"), ("3", "np"), ("表1：收入", "c"), ("图书馆", "c"), ("收入表", ""), ("请务必阅读正文之后的免责条款", "d")])
def test_predicates(spark, text, flags):
    row = spark.createDataFrame([(text,)], "c string").select(*(f(F.col("c")) for f in (X.numeric_like, X.numeric_or_period_like, X.page_number_like, X.caption_like, X.disclaimer_like))).first()
    assert "".join(k for k, v in zip("npgcd", row) if v) == flags


def test_to_int(spark):
    assert [one(spark, t, X.to_int) for t in ("", "x", " 12 ", "1_000", "7", "99999999999")] == [None, None, 12, None, 7, None]


# --- chunks


def cut(text, size, overlap):
    text, out, start = normal(text), [], 0
    while start < len(text):
        if piece := text[start : start + size].strip():
            out.append(piece)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4), (2, 1), (1, 0)])
def test_windows(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab \n中😀") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["x" * 24, "x" * 10, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in chunking.split_texts(df, "k", "t", size, overlap).orderBy("k", "piece").collect():
        got.setdefault(r.k, []).append(r.text)
    assert all(got.get(k, []) == cut(t, size, overlap) for k, t in enumerate(texts))


def test_bad_parameters():
    for bad in ("512", "0:0", "5:5", "5:-1"):
        with pytest.raises(ValueError):
            chunking.parse_config(bad)
    assert chunking.parse_config("512:100") == chunking.parse_config("512,100") == (512, 100)


def pack(caption, rows, size):
    heads = [normal(t) for _, t, h in rows if h]
    data = [(k, normal(t)) for k, t, h in rows if not h]
    prefix = "\n".join(x for x in [normal(caption), *heads] if x)
    if not data:
        return [prefix] if prefix else []
    parts, now, n = [], prefix, 0
    for _, t in data:
        if not t:
            continue
        if n and len(now) + 1 + len(t) > size:
            parts.append(now)
            now, n = prefix, 0
        now, n = f"{now}\n{t}" if now else t, n + 1
    return parts + ([now] if now else [])


def test_packing(spark):
    rng = random.Random(3)
    made = [(f"T{k}", rng.choice(["", "C"]), [(i, rng.choice(["", "r" * rng.randint(1, 30)]), i == 0 and rng.random() < 0.6) for i in range(rng.randint(1, 8))]) for k in range(120)]
    rows = [(i, "d", 1, c, "whole", len(r), [(k, t, h) for k, t, h in r]) for i, c, r in made] + [("N", "d", 1, None, "y" * 5000, None, None), ("E", "d", 1, None, None, None, [])]
    df = spark.createDataFrame(rows, "table_id string, doc_id string, page int, caption string, text string, rows int, protected_rows array<struct<row:int,text:string,is_header:boolean>>")
    got = {}
    for r in chunking.table_chunks(df, 12).orderBy("table_id", "part_index").collect():
        assert r.chunk_id == (r.table_id if r.part_count == 1 else f"{r.table_id}-part{r.part_index:03d}")
        got.setdefault(r.table_id, []).append(r.text)
    assert all(got.get(i, []) == pack(c, r, 12) for i, c, r in made)
    assert got["N"] == ["y" * 5000] and "E" not in got


def test_fallback_and_ids(spark):
    section = "array<struct<section_id:string,text:string,layout_type:string>>"
    df = spark.createDataFrame([("d", "s", 1, "t", [("x", " ", None)], "m"), ("d", "s", 2, "t", [("x", "y", ""), (None, "z", "title")], "m"), ("d", "s", 3, None, None, "m")], f"doc_id string, source string, page int, text string, sections {section}, metadata string")
    assert [r.chunk_id for r in chunking.fallback_chunks(df, 10, 0).collect()] == ["d-p001-c001"]
    assert sorted((r.chunk_id, r.chunk_type) for r in chunking.section_chunks(df, 10, 0).collect()) == [("d-p002-s002-c001", "title"), ("x-c001", "text")]


# --- tables


def table(spark, rows, caption=""):
    cells = [(r, c, t, None, None, 1, 1, None) for r, line in enumerate(rows) for c, t in enumerate(line)]
    return spark.createDataFrame([("T", caption, cells)], f"table_id string, caption string, cells {CELL}")


def test_structure(spark):
    t = tables.structured(table(spark, [["公司", "2023A"], ["比亚迪", "毛利率"], ["x", "1"], ["", " "], [None, "<2>"]], "C")).first()
    assert t.header_rows_ == [0, 1]
    assert [(h.col, h.text) for h in t.headers_] == [(0, "公司的比亚迪"), (1, "2023A的毛利率")]
    assert [(r.row, r.text) for r in t.rows_] == [(0, "公司 | 2023A"), (1, "比亚迪 | 毛利率"), (2, "公司的比亚迪: x; 2023A的毛利率: 1 -- 来自「C」"), (4, "2023A的毛利率: <2> -- 来自「C」")]
    assert t.markdown_.split("\n")[:3] == ["C", "| 公司 | 2023A |", "| --- | --- |"] and "行级描述:" in t.text_
    h = tables.with_headers(tables.with_matrix(table(spark, [["a", "b"], ["1", "<2>"]])))
    assert "<td>&lt;2&gt;</td>" in h.select(tables.html(F.col("caption"), F.col("matrix_"), F.col("header_rows_"), F.col("cells")).alias("x")).first().x


def test_tables_without_cells(spark):
    for rows in ([], [[""]], [[None, " "]]):
        t = tables.structured(table(spark, rows)).first()
        assert t.text_ == "" and t.rows_ == []
    none = spark.createDataFrame([("T", None, None)], f"table_id string, caption string, cells {CELL}")
    assert tables.structured(none).first().text_ == ""


def test_spans(spark):
    cells = [(0, 0, "a", [0.0, 0.0, 20.0, 10.0], None, None, None, None), (1, 0, "b", [0.0, 10.0, 10.0, 20.0], None, None, None, None), (1, 1, "c", [10.0, 10.0, 20.0, 20.0], None, None, None, None), (2, 0, "d", None, None, None, None, None)]
    df = spark.createDataFrame([("T", cells)], f"table_id string, cells {CELL}")
    got = {(r.row, r.col): (r.row_span, r.col_span) for r in tables.spans(df).collect()}
    assert got == {(0, 0): (1, 2), (1, 0): (1, 1), (1, 1): (1, 1)}


# --- layout

BOX = "doc_id string, page int, page_width double, page_height double, box_ord int, box_id string, text string, x0 double, top double, x1 double, bottom double, font_size double"
TAB = f"table_id string, doc_id string, page int, caption string, bbox array<double>, source string, cells {CELL}"


def boxes(spark, rows):
    return spark.createDataFrame([("d", p, 600.0, 800.0, k, f"b{k}", t, x, y, x + w, y + 10.0, f) for k, (p, t, x, y, w, f) in enumerate(rows)], BOX)


def test_margins_tags_and_sections(spark):
    rows = [(p, "某某证券研究报告", 50.0, 20.0, 100.0, 8.0) for p in (1, 2)] + [(p, f"正文{p}", 50.0, 300.0, 100.0, 10.0) for p in (1, 2, 3)]
    rows += [(1, "大标题", 50.0, 100.0, 100.0, 20.0), (1, "1/3", 300.0, 780.0, 20.0, 8.0), (1, "表1：收入", 50.0, 500.0, 100.0, 10.0), (1, "单元格", 60.0, 560.0, 50.0, None), (1, None, 50.0, 400.0, 10.0, 9.0), (1, "正文后", 50.0, 312.0, 100.0, 10.0), (1, "远", 50.0, 345.0, 100.0, 10.0)]
    df = boxes(spark, rows)
    tab = spark.createDataFrame([("d-p001-t001", "d", 1, None, [40.0, 540.0, 400.0, 700.0], "s", None)], TAB)
    assert [tuple(r) for r in layout.repeated_margins(df).collect()] == [("d", "某某证券研究报告")]
    tags = layout.tagged(df, tab)
    kind = {r.text: r.layout_type for r in tags.collect()}
    assert kind == {"某某证券研究报告": "header", "正文1": "text", "正文2": "text", "正文3": "text", "大标题": "title", "1/3": "footer", "表1：收入": "table caption", "单元格": "table", None: "text", "正文后": "text", "远": "text"}
    assert [tuple(r) for r in layout.attached_captions(tags, tab).collect()] == [("d-p001-t001", "表1：收入")]
    texts = {(r.page, r.text) for r in layout.sections(layout.with_columns(tags)).collect()}
    assert texts == {(1, "大标题"), (1, "正文1\n正文后"), (1, "远"), (2, "正文2"), (3, "正文3")}
    assert layout.assembled(df.limit(0), tab).count() == 0 and layout.tagged(df, tab.limit(0)).count() == len(rows)


def test_columns(spark):
    seven = [(1, f"t{k}", 50.0 + 300 * (k % 2), 100.0 + 20 * k, 100.0, 10.0) for k in range(7)]
    none = spark.createDataFrame([], TAB)
    ids = lambda rows: [r.col_id for r in layout.with_columns(layout.tagged(boxes(spark, rows), none)).orderBy("box_ord").collect()]
    assert ids(seven) == [0] * 7
    assert ids([*seven, (1, "t7", 350.0, 300.0, 100.0, 10.0)]) == [0, 1, 0, 1, 0, 1, 0, 1]


def test_tables_without_lines(spark):
    grid = [["指标", "2022", "2023", "2024"], ["收入", "1,234", "5.6%", "7"], ["成本", "8", "(9)", "10"], ["利润", "1", "2", "3"]]
    rows = [(1, "表1：主要数据", 50.0, 80.0, 100.0, 10.0), (1, "联系人", 580.0, 100.0, 15.0, 10.0)] + [(1, t, 50.0 + 100 * c, 100.0 + 20 * r, 60.0, 10.0) for r, line in enumerate(grid) for c, t in enumerate(line)]
    none = spark.createDataFrame([], TAB)
    found = layout.detected_tables(boxes(spark, rows), none).collect()
    assert [(t.table_id, t.caption, len(t.cells)) for t in found] == [("d-p001-layout-t001", "表1：主要数据", 16)]
    there = spark.createDataFrame([("t", "d", 1, None, [40.0, 90.0, 500.0, 200.0], "s", None)], TAB)
    assert layout.detected_tables(boxes(spark, rows), there).count() == 0


def test_detected_tables_query_leaves_out_known_tables(spark, tmp_path):
    grid = [["指标", "2022", "2023", "2024"], ["收入", "1,234", "5.6%", "7"], ["成本", "8", "(9)", "10"], ["利润", "1", "2", "3"]]
    rows = [(p, t, 50.0 + 100 * c, 100.0 + 20 * r, 60.0, 10.0) for p in (1, 2) for r, line in enumerate(grid) for c, t in enumerate(line)]
    boxes(spark, rows).withColumn("loaded_at", F.lit(1)).write.parquet(str(tmp_path / "text_boxes.parquet"))
    known = spark.createDataFrame([("t", "d", 1, None, [40.0, 90.0, 500.0, 200.0], "s", None)], TAB)
    known.withColumn("parsed_at", F.lit(1)).write.parquet(str(tmp_path / "structured_tables.parquet"))
    assert [r.table_id for r in layout_queries.layout_detected_tables(spark, str(tmp_path)).collect()] == ["d-p002-layout-t001"]
    known.withColumn("parsed_at", F.lit(1)).limit(0).write.mode("overwrite").parquet(str(tmp_path / "structured_tables.parquet"))
    assert layout_queries.layout_detected_tables(spark, str(tmp_path)).count() == 2


FIGURE_ROW, PLAIN_ROW, NOTE = ["指标", "1", "2", "3"], ["甲", "乙", "丙"], ["注"]


@pytest.mark.parametrize("made,rows", [
    ([FIGURE_ROW] * 3, {1: [1, 2, 3]}), ([FIGURE_ROW] * 2, {}), ([FIGURE_ROW, NOTE, FIGURE_ROW, FIGURE_ROW], {1: [1, 3, 4]}), ([FIGURE_ROW, NOTE, NOTE, FIGURE_ROW, FIGURE_ROW], {}), ([FIGURE_ROW, PLAIN_ROW, FIGURE_ROW, FIGURE_ROW], {}),
    ([NOTE, *[FIGURE_ROW] * 3, PLAIN_ROW, *[FIGURE_ROW] * 4], {1: [2, 3, 4], 2: [6, 7, 8, 9]}), ([*[FIGURE_ROW] * 2, PLAIN_ROW, *[FIGURE_ROW] * 3, NOTE], {1: [4, 5, 6]}), ([["1", "2", "3", "4"]] * 3, {}), ([["甲", "乙", "丙", "4"]] * 3, {}), ([], {}),
])
def test_runs(spark, made, rows):
    placed = spark.createDataFrame([("d", 1, r, c, f"{r}-{c}", t, 10.0 * c, 20.0 * r, 10.0 * c + 5, 20.0 * r + 9) for r, line in enumerate(made, 1) for c, t in enumerate(line, 1)], "doc_id string, page int, row int, col int, box_id string, text string, x0 double, top double, x1 double, bottom double")
    got = {}
    for r in layout.table_runs(placed).select("run", "row").distinct().orderBy("row").collect():
        got.setdefault(r.run, []).append(r.row)
    assert got == rows


def test_rows_follow_the_mean_of_their_middles(spark):
    tops = [100.0, 105.0, 112.0, 111.0, 130.0]  # of height 10: within 6.5 of the mean so far
    made = [(1, f"t{k}", 50.0 + 10 * k, y, 20.0, 10.0) for k, y in enumerate(tops)]
    got = {r.text: (r.row, r.col) for r in layout.box_rows(boxes(spark, made), spark.createDataFrame([], TAB)).collect()}
    assert got == {"t0": (1, 1), "t1": (1, 2), "t2": (2, 1), "t3": (2, 2), "t4": (3, 1)} or got == {"t0": (1, 1), "t1": (1, 2), "t3": (2, 2), "t2": (2, 1), "t4": (3, 1)}


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w"), ("c", 5, "v"), ("c", 5, "v"), (None, 1, "n"), (None, 1, "m")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    for most in (0, 100):
        assert sorted(chunking.latest(df, ["k"], "at", most).collect(), key=str) == sorted([("a", 2, "y"), ("b", 0, "w"), ("c", 5, "v"), (None, 1, "n"), (None, 1, "m")], key=str)
    assert chunking.latest(df.limit(0), ["k"], "at").count() == 0


# --- catalogue and sources


def test_manifest_and_validation(spark, tmp_path):
    raw = tmp_path / "raw"
    for name in ("policy/a.pdf", "root.pdf", "policy/deep/c.PDF", "policy/deep/d.pdf"):
        (raw / name).parent.mkdir(parents=True, exist_ok=True)
        (raw / name).write_bytes(b"12345")
    lines = ["doc_id,file_path,title,industry,doc_type,year_month,source_url,pages,file_size_bytes,notes", f'a,{raw}/policy/a.pdf,"A, ""B""", 政策 ,policy,,, 12 ,5,', f",{raw}/Gone File.pdf,,,,,,x,,", "b,,,,,,,,,", f"a,{raw}/root.pdf,,,,,,1_000,,"]
    (tmp_path / "m.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    listed = catalog.manifest_records(files.read_manifest(spark, str(tmp_path / "m.csv")))
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in listed.collect()}
    assert rows["a.pdf"].title == 'A, "B"' and rows["a.pdf"].industry == "政策" and rows["a.pdf"].expected_pages == 12
    assert rows["Gone File.pdf"].doc_id == "gone_file" and rows["Gone File.pdf"].expected_pages is None and rows["root.pdf"].expected_pages is None
    found = catalog.discovered_records(files.find_files(spark, str(raw)), str(raw))
    assert {(r.title, r.industry) for r in found.collect()} == {("a", "policy"), ("root", ""), ("d", "policy")}
    assert {r.title for r in catalog.unlisted(found, listed).collect()} == {"d"}
    check = catalog.validation(listed, found).first()
    assert (check.duplicate_doc_ids, check.missing_paths, check.unlisted_files, check.status) == (1, 1, 1, "FAIL")
    assert catalog.documents(listed, found.select(*listed.columns)).count() == 3 and catalog.documents(listed, found.select(*listed.columns), False).count() == 2
    assert catalog.validation(listed.limit(0), found.limit(0)).first().status == "OK"
    assert catalog.metadata(listed).where("doc_id = 'a'").first().metadata.title == 'A, "B"'
    with pytest.raises(SystemExit):
        cli.main(["validate-dataset", "--manifest", str(tmp_path / "m.csv"), "--raw-dir", str(raw)], spark)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "中\n文", None), (2, None, [1])], "a int, b string, c array<int>")
    assert files.write_jsonl(df, str(tmp_path / "x")) == 2
    assert sorted(files.read_jsonl(spark, str(tmp_path / "x"), df.schema).collect()) == sorted(df.collect())
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": ')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_command_line(spark, tmp_path):
    def extract(path, content):
        if content == b"bad":
            raise ValueError("no document")
        for k, line in enumerate(content.decode().split("\n")):
            yield (path.rsplit("/", 1)[1][:-4], 1, 600.0, 800.0, k, f"b{k}", line, 50.0, 100.0 + 12 * k, 300.0, 110.0 + 12 * k, 10.0, 1, k, "test")

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/one.pdf").write_bytes("第一行文字\n第二行文字关于储能".encode())
    (tmp_path / "raw/two.pdf").write_bytes(b"bad")
    assert files.text_boxes(spark, str(tmp_path / "raw"), extract).where("source = 'error'").count() == 1
    boxes_df = files.text_boxes(spark, str(tmp_path / "raw"), extract).where("page is not null").drop("path")
    none = spark.createDataFrame([], "doc_id string, source string, metadata string")
    pages = layout.page_records(boxes_df, tables.records(spark.createDataFrame([], TAB)), none).withColumn("source", F.lit("s")).drop("metadata")
    files.write_jsonl(pages, str(tmp_path / "pages"))
    root = ["--root", str(tmp_path)]
    assert cli.main(["build-chunks", "--input", "pages", "--output", "chunks", *root], spark) == "chunks: 1"
    assert cli.main(["build-index", "--chunks", "chunks", "--index-path", "index", "--meta-path", "meta", *root], spark) == "chunks: 1\ndimension: 256"
    assert files.read_jsonl(spark, str(tmp_path / "meta"), cli.CHUNK).first().pages == [1]
    assert "one p.1" in cli.main(["search", "--query", "储能", "--index-path", "index", *root], spark)
    assert "| 512 | 100 | 1 |" in cli.main(["chunking-experiment", "--input", "pages", "--report", "out/report.md", "--output-dir", "sweep", *root], spark)
    assert files.read_jsonl(spark, str(tmp_path / "sweep/chunks_256_50.jsonl"), cli.CHUNK).count() == 1
    assert "储能" in cli.main(["inspect-chunks", "--chunks", "chunks", "--keyword", "储能", *root], spark)


def lines_of(path, content):
    for k, line in enumerate(content.decode().split("\n")):
        yield ("own", 1, 600.0, 800.0, k, f"b{k}", line, 50.0, 100.0 + 12 * k, 300.0, 110.0 + 12 * k, 10.0, 1, k, "test")
    yield ("own", 2, 600.0, 800.0, *[None] * 10, "test")


def grid_of(path, content):
    yield (1, [50.0, 300.0, 250.0, 340.0], [(0, 0, "项目", [50.0, 300.0, 150.0, 320.0]), (0, 1, "2023", [150.0, 300.0, 250.0, 320.0]), (1, 0, "收入", [50.0, 320.0, 150.0, 340.0]), (1, 1, "5", [150.0, 320.0, 250.0, 340.0])])
    yield (1, None, [(0, 0, "x", None), (0, 1, "y", None), (1, 0, "z", None)])
    raise ValueError("broken")


def test_relative_paths(spark, tmp_path, monkeypatch):
    raw = tmp_path / "data/raw/policy"
    raw.mkdir(parents=True)
    (raw / "a.pdf").write_bytes("第一行\n第二行".encode())
    head = "doc_id,file_path,title,industry,doc_type,year_month,source_url,pages,file_size_bytes,notes"
    (tmp_path / "m.csv").write_text(f"{head}\na,data/raw/policy/../policy/./a.pdf,T,政策,policy,,,2,5,\n", encoding="utf-8")
    monkeypatch.chdir(tmp_path)
    said = cli.main(["validate-dataset", "--manifest", "m.csv", "--raw-dir", "data/raw"], spark)
    assert said.endswith("status: OK") and "missing_paths: 0" in said
    (raw / "b.pdf").write_bytes(b"x")
    with pytest.raises(SystemExit, match="unlisted_files: 1\n  - data/raw/policy/b.pdf"):
        cli.main(["validate-dataset", "--manifest", "m.csv", "--raw-dir", "data/raw"], spark)
    found = {r.file_path: r.industry for r in catalog.discovered_records(files.find_files(spark, str(tmp_path / "data/raw")), "data/raw", str(tmp_path)).collect()}
    assert found == {"data/raw/policy/a.pdf": "policy", "data/raw/policy/b.pdf": "policy"}
    with pytest.raises(SystemExit, match="unlisted_files: 2"):
        cli.main(["validate-dataset", "--manifest", "none.csv", "--raw-dir", "data/raw"], spark)
    said = cli.main(["parse-pdfs", "--manifest", "m.csv", "--raw-dir", "data/raw", "--output", "pages.jsonl", "--manifest-only", "--extractor", f"{__name__}:lines_of", "--tables", f"{__name__}:grid_of"], spark)
    assert said == "documents: 1\npages: 2"
    pages = {r.page: r for r in spark.read.json(str(tmp_path / "pages.jsonl")).collect()}
    assert pages[1].doc_id == "a" and pages[1].metadata.title == "T" and pages[1].source == "data/raw/policy/../policy/./a.pdf" and pages[1].text == "第一行\n第二行" and pages[2].parser.text_box_count == 0
    assert [(t.table_id, t.rows, t.columns) for t in pages[1].tables] == [("a-p001-t001", 2, 2), ("a-p001-t002", 2, 2)] and [a.type for a in pages[1].layout_regions] == ["table"]
    assert "行级描述" in pages[1].tables[0].text and "行级描述" not in pages[1].tables[1].text and pages[1].parser.table_count == 2 and len(pages[1].text_boxes) == 2
    assert cli.main(["build-chunks", "--input", "pages.jsonl", "--output", "chunks.jsonl"], spark) == "chunks: 3"
    chunk = {r.chunk_id: r for r in files.read_jsonl(spark, str(tmp_path / "chunks.jsonl"), cli.CHUNK).collect()}["a-p001-t001"]
    assert chunk.metadata.title == "T" and chunk.table.html.startswith("<table>") and chunk.table.table_protection == "row_boundary" and chunk.section is None and len(chunk.table.cells) == 4


def test_tables_over_pages(spark):
    made = [("t1", 1, "年|收入"), ("t2", 1, "年|成本"), ("t3", 2, "年|成本"), ("t4", 3, "年|成本"), ("t5", 3, "年|收入"), ("t6", 5, "年|收入"), ("t7", 6, "|"), ("t8", 7, "|")]
    rows = [(i, "d", p, 2, [(0, c, t, None, None, 1, 1, None) for c, t in enumerate(h.split("|"))]) for i, p, h in made] + [("u", "e", 2, None, None)]
    got = {r.table_id: (r.pages, r.parts) for r in tables.page_ranges(spark.createDataFrame(rows, f"table_id string, doc_id string, page int, columns int, cells {CELL}")).collect()}
    assert got == {"t1": ([1], ["t1"]), "t2": ([1, 2, 3], ["t2", "t3", "t4"]), "t5": ([3], ["t5"]), "t6": ([5], ["t6"]), "t7": ([6], ["t7"]), "t8": ([7], ["t8"]), "u": ([2], ["u"])}


def test_hybrid_against_plain_python(spark):
    rng = random.Random(3)
    lists = [[(q, i, round(rng.random(), 2)) for q in range(4) for i in rng.sample(range(12), 6)] for _ in range(2)]
    lists[0] = [x for x in lists[0] if x[0] != 3]
    scheme = "query_id bigint, id bigint, score double"
    got = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.fused(*(spark.createDataFrame(x, scheme) for x in lists), k=5).collect()}
    for q in range(4):
        total = {}
        for share, given in zip((0.6, 0.4), lists):
            own = {i: s for p, i, s in given if p == q}
            for i, s in own.items():
                low, high = min(own.values()), max(own.values())
                total[i] = total.get(i, 0.0) + share * ((s - low) / (high - low) if high > low else 1.0)
        best = sorted((-round(s, 6), i) for i, s in total.items())[:5]
        assert [got[q, k][0] for k in range(1, len(best) + 1)] == [i for _, i in best]


def test_tables_are_streamed(spark, tmp_path):
    rows = "array<struct<row:int,text:string,is_header:boolean>>"
    page = [("d", "s", 1, "文", [], [("T", "C", "x", 2, [(0, "h", True), (1, "r", False)]), (None, None, "y", 1, None)], "m")]
    df = spark.createDataFrame(page, f"doc_id string, source string, page int, text string, sections array<struct<section_id:string,text:string,layout_type:string>>, tables array<struct<table_id:string,caption:string,text:string,rows:int,protected_rows:{rows}>>, metadata string")
    df.write.parquet(str(tmp_path / "in"))
    out = stream.run_once(stream.chunk_stream(stream.page_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.chunk_id, r.text) for r in out.collect()) == [("T", "C\nh\nr"), ("d-p001-c001", "文"), ("d-p001-t002", "y")]


def test_tables_from_geometry(spark):
    cell = lambda r, c, t, x0, y0, x1, y1: (r, c, t, [x0, y0, x1, y1], None, 1, 1, None)
    cells = [cell(0, 0, "项目", 0.0, 0.0, 50.0, 10.0), cell(0, 1, "2023", 50.0, 0.0, 100.0, 10.0), cell(1, 0, None, 0.0, 10.0, 50.0, 20.0), cell(1, 1, "7", 50.0, 10.0, 100.0, 20.0), cell(2, 0, "合计 9", 0.0, 20.0, 100.0, 30.0), (3, 0, "no bbox", None, None, 1, 1, None), cell(4, 0, " ", 0.0, 30.0, 50.0, 40.0)]
    drawn = spark.createDataFrame([("T", "d", 1, None, [0.0, 0.0, 100.0, 40.001], "s", cells), ("E", "d", 2, "", None, "s", [])], TAB)
    put = spark.createDataFrame([("d", 1, "b1", "收入", 1.0, 11.0, 20.0, 19.0), ("d", 1, "b2", "7", 60.0, 11.0, 70.0, 19.0)], "doc_id string, page int, box_id string, text string, x0 double, top double, x1 double, bottom double")
    rows = {r.table_id: r for r in tables.from_geometry(drawn, put).collect()}
    t = rows["T"]
    assert (t.rows, t.columns, t.bbox) == (3, 2, [0.0, 0.0, 100.0, 40.0]) and "| 项目 | 2023 |" in t.text and "| | 7 |" in t.text and "项目: 收入; 2023: 7" in t.text
    assert {(c.row, c.col): (c.text, c.row_span, c.col_span, c.is_header, c.text_box_ids) for c in t.cells} == {(0, 0): ("项目", 1, 1, True, []), (0, 1): ("2023", 1, 1, True, []), (1, 0): ("收入", 1, 1, False, ["b1"]), (1, 1): ("7", 1, 1, False, ["b2"]), (2, 0): ("合计 9", 1, 2, False, [])}
    assert '<td colspan="2">合计 9</td>' in t.html and "<td>收入</td>" in t.html and rows["E"].text == "" and rows["E"].cells == []


def test_stream_equals_batch(spark, tmp_path):
    section = "array<struct<section_id:string,text:string,layout_type:string>>"
    df = spark.createDataFrame([("d", "s", k, "t", [(f"s{k}", "文" * 700, "text")], "m") for k in range(5)], f"doc_id string, source string, page int, text string, sections {section}, metadata string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = stream.run_once(stream.chunk_stream(stream.page_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.chunk_id for r in out.collect()) == sorted(r.chunk_id for r in chunking.section_chunks(df, 512, 100).collect())


# --- retrieval


def test_vector_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10] = v[11]
    rows = spark.createDataFrame([(k, v[k].tolist()) for k in range(300)] + [(None, v[0].tolist()), (900, None), (901, [])], "id bigint, embedding array<float>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.id for r in retrieval.vector_topk(rows, asked, 4, block=7).collect()}
    for q in range(0, 300, 20):
        scores = v.astype(float) @ v[q].astype(float)
        assert [got[q, k] for k in range(1, 5)] == sorted(range(300), key=lambda i: (-scores[i], i))[:4]
    assert retrieval.vector_topk(rows, asked.limit(0), 4).count() == 0 and retrieval.vector_topk(rows.limit(0), asked, 4).count() == 0
    assert retrieval.vector_topk(rows, asked.limit(1), 1000).count() == 300


def test_clustered_search_as_registered(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 32)).astype(np.float32)
    v[:200] += rng.normal(size=(4, 32)).astype(np.float32).repeat(50, 0) * 6
    rows = spark.createDataFrame([(k, v[k].tolist()) for k in range(600)] + [(None, v[0].tolist()), (900, None), (901, [])], "id bigint, embedding array<float>").selectExpr("*", "7 as cell", "1 as score")
    asked = rows.where("id % 10 = 0 and id < 600").select(F.col("id").alias("query_id"), "embedding")
    retrieval.save_ivf(rows, str(tmp_path / "ivf"))
    exact = {(q, i) for q in range(0, 600, 10) for i in sorted(range(600), key=lambda i, s=v.astype(float) @ v[q].astype(float): (-s[i], i))[:5]}
    got = {(r.query_id, r.id) for r in retrieval.ivf_topk(spark, str(tmp_path / "ivf"), asked, 5, block=17).collect()}
    assert spark.read.parquet(str(tmp_path / "ivf/rows")).count() == 600 and len(got & exact) / len(exact) >= 0.9
    everything = {(r.query_id, r.id) for r in retrieval.ivf_topk(spark, str(tmp_path / "ivf"), asked, 5, probes=16).collect()}
    assert everything == exact
    one = retrieval.ivf_topk(spark, str(tmp_path / "ivf"), asked.limit(1), 5, probes=2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString() and retrieval.ivf_topk(spark, str(tmp_path / "ivf"), asked.limit(0), 5).count() == 0


def test_word_search_against_brute_force(spark):
    rng = random.Random(11)
    texts = {k: "".join(rng.choice("储能电池价格 ab1，") for _ in range(rng.randint(0, 40))) for k in range(60)}
    asked = {1: "储能 ab", 2: "电池价格", 3: "", 4: None, 5: "zzz"}
    split = lambda t: [m for run in re.findall("[一-鿿]+", (t or "").lower()) for m in ([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])] + re.findall("[a-z0-9]+", (t or "").lower())
    words = {k: split(t) for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    expected = {}
    for q, text in asked.items():
        scores = {}
        for term in set(split(text)):
            df = sum(term in w for w in words.values())
            for k, w in words.items():
                if tf := w.count(term):
                    scores[k] = scores.get(k, 0) + np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        expected |= {(q, r): k for r, (k, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 4), x[0]))[:5], 1)}
    rows = spark.createDataFrame([*texts.items(), (None, "储能")], "id bigint, text string").selectExpr("*", "1 as length", "2 as score", "'x' as term")
    queries = spark.createDataFrame([*asked.items(), (None, "储能")], "query_id bigint, query string")
    for bound in (0, 100):
        assert {(r.query_id, r.rank): r.id for r in retrieval.bm25_topk(rows, queries, 5, terms_at_once=bound).collect()} == expected
        assert retrieval.bm25_topk(rows.limit(0), queries, 5, terms_at_once=bound).count() == 0 and retrieval.bm25_topk(rows, queries.limit(0), 5, terms_at_once=bound).count() == 0


def test_clustered_search_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "id bigint, embedding array<float>")
    retrieval.save_ivf(rows, str(tmp_path / "ivf"))
    assert retrieval.ivf_topk(spark, str(tmp_path / "ivf"), rows.withColumnRenamed("id", "query_id"), 5).count() == 0


def test_vectors_of_one_size(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, embedding array<float>")
    with pytest.raises(ValueError):
        retrieval.same_size(rows)
    with pytest.raises(ValueError):
        retrieval.same_size(rows.limit(0))
    with pytest.raises(Exception, match="has not 2 dimensions"):
        retrieval.vector_topk(rows, rows.where("id = 1").withColumnRenamed("id", "query_id"), 1).collect()


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.x for r in df.select(l2_normalize(F.col("v")).alias("x")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_encoder(spark):
    df = spark.createDataFrame([(1, "储能电池"), (2, None), (3, "储能电池")], "id bigint, text string")
    v = {r.id: r.embedding for r in retrieval.encoded(df, "text").collect()}
    assert v[1] == v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-5 and set(v[2]) == {0.0}
    assert retrieval.encoded(df.limit(0), "text").count() == 0
    odd = ["", " ", "a", " a b ", "ab", "储", "x" * 3000, "\ud800"]
    whole = retrieval.HashingEncoder().encode(odd)
    assert all(np.array_equal(whole[k], retrieval.HashingEncoder().encode([t])[0]) for k, t in enumerate(odd)) and not whole[0].any() and not whole[1].any() and whole[2].any()
    assert np.abs(whole[6]).sum() >= 2999


class Plain:
    def encode(self, texts, batch_size=1):
        return np.ones((len(texts), 4)) * batch_size


class Full(Plain):
    def encode_queries(self, texts, batch_size, max_length, normalize_embeddings):
        return np.full((len(texts), 2), max_length)


def test_encoder_adapter():
    C, E = retrieval.EncoderConfig, retrieval.Encoder
    seen = []
    assert E(C(load=lambda name, use_fp16: seen.append((name, use_fp16)) or Plain(), model_name="m", use_fp16=True, batch_size=3)).encode(["a"]).tolist() == [[0.5] * 4] and seen == [("m", True)]
    assert E(C(load=lambda name, query_instruction_for_retrieval, use_fp16: seen.append(query_instruction_for_retrieval) or Full(), max_length=9, normalize=False)).encode(["a"], queries=True).tolist() == [[9.0, 9.0]] and seen[-1] == C().query_instruction
    assert E(C(load=Plain, batch_size=2, normalize=False)).encode(["a"], queries=True).tolist() == [[2.0] * 4] and E(C(load=Plain)).encode([]).shape == (0, 0)
    with pytest.raises(RuntimeError):
        E(C(load=lambda: object())).encode(["a"])


def test_evaluation(spark):
    found = spark.createDataFrame([(1, 1, "x"), (1, 2, "k"), (2, 1, "z")], "query_id bigint, rank int, key string")
    truth = spark.createDataFrame([(1, "k", "fact"), (2, "q", "fact")], "query_id bigint, key string, question_type string")
    rows = retrieval.evaluated(lambda q: found, truth.select("query_id"), truth, ks=(1, 3)).orderBy("k").collect()
    assert [(r.k, r.recall) for r in rows] == [(1, 0.0), (3, 0.5)] and rows[0].seconds_per_query > 0


def test_answers_and_expansion(spark):
    found = spark.createDataFrame([(1, 1, 7, 3.0)], "query_id bigint, rank int, id bigint, score double")
    rows = spark.createDataFrame([(7, "收入 1,234.5 万元，增长 8%")], "id bigint, text string")
    asked = spark.createDataFrame([(1, "1234.5 与 8"), (2, "9"), (3, None)], "query_id bigint, answer string")
    got = {r.query_id: (r.numbers, r.unsupported, r.supported, r.abstain) for r in retrieval.answer_checks(asked, found, rows).collect()}
    assert got == {1: (2, 0, True, False), 2: (1, 1, False, True), 3: (0, 0, True, True)}
    more = retrieval.expanded(spark.createDataFrame([(1, "储能价格")], "query_id bigint, query string"), spark.createDataFrame([("储能", "蓄能"), (None, "x")], "term string, synonym string"))
    assert {r.query for r in more.collect()} == {"储能价格", "蓄能价格"}


# --- 2: quantities in different units

TABLES = f"table_id string, doc_id string, page int, caption string, parsed_at int, cells {CELL}"
TERMS = [(1, "营业收入", "money"), (2, "毛利率", "ratio"), (3, "EBITDA（调整后）", "money"), (4, "EBITDA", "money"), (5, "年发电量", "energy"), (6, "风险提示", None), (None, None, None), (None, "营业收入", "money")]


def sheet(name, rows, caption=None, page=1):
    return (name, "d", page, caption, 1, [(r, c, t, None, None, 1, 1, None) for r, line in enumerate(rows) for c, t in enumerate(line)])


@pytest.mark.parametrize("spelling,unit", [("万元", ("money", 1e4)), ("（单位：百万元）", ("money", 1e6)), ("RMB million unless stated", ("money", 1e6)), ("RMB'000", ("money", 1e3)), ("RMB 000", ("money", 1e3)), ("rmb bn", ("money", 1e9)), ("％", ("ratio", 0.01)), ("Kwh", ("energy", 1.0)), ("人民币亿元，另有注明除外", ("money", 1e8)), ("RMB millions", ("money", 1e6)), ("亿", None), ("备注", None), ("", None), (None, None), ("tonne", ("mass", 1.0)), ("hectare", ("area", 1e4)), ("percnt", ("ratio", 0.01)), ("kilowatt", ("power", 1.0)), ("kWhs", ("energy", 1.0)), ("square metre", ("area", 1.0)), ("百分点", ("ratio", 0.01)), ("milion", ("money", 1e6)), ("RMB milion", ("money", 1e6)), ("gigawat hours", ("energy", 1e6)), ("Metric ton", ("mass", 1.0)), ("bilion", ("money", 1e9)), ("kWp", None), ("元/吨", None), ("万股", None), ("t/d", None), ("GWh", ("energy", 1e6)), ("MWh", ("energy", 1e3)), ("MW", ("power", 1e3)), ("RMB xn", None)])
def test_units_are_read(spelling, unit):
    assert units.read_unit(spelling, units.unit_index()) == unit


def test_figures_and_contradictions(spark):
    made = [
        sheet("t1", [["项目", "2022年", "2023A(亿元)", "备注"], ["营业收入（万元）", "12,345", "1.5亿元", "x"], ["毛利率", "12.5%", "130‰", None], ["ＥＢＩＴＤＡ(调整后)", "（3.0）", "-", ""], ["年发电量，GWh", "2", "3 MWh", "1"]]),
        sheet("t2", [["(千元)", "2022", "2023"], ["营​业收入", "123450", "160,000"], ["毛利率，%", "12.4", "13"], ["EBITDA（调整后）", "3000", "1"], ["风险提示", "1", "2"]]),
        sheet("t3", [["", "FY2022"], ["營業收入", "1.3"], ["EBITDA小计", "5"]], "表3：摘要，单位为亿元"),
        sheet("t4", [["", "2022"], ["营业收入", "7"]]),
        sheet("t5", [["", "2022"], ["营业收入(元)", "9"]], None, 2),
        ("t6", "d", 1, None, 1, None), ("t7", None, None, None, None, []), (None, "d", 1, None, 1, []),
    ]
    made.append(made[1])
    df = spark.createDataFrame(made, TABLES).selectExpr("*", "1 as label", "'x' as spelling", "2 as value", "3 as size")
    terms = spark.createDataFrame(TERMS, "term_id bigint, term string, measure string").selectExpr("*", "'q' as label")
    values = units.figures(df, terms)
    got = {r.cell_id: (r.term_id, round(r.value, 6)) for r in values.collect()}
    assert got == {
        "t1-r1c1": (1, 123450000.0), "t1-r1c2": (1, 150000000.0), "t1-r2c1": (2, 0.125), "t1-r2c2": (2, 0.13), "t1-r4c1": (5, 2000000.0), "t1-r4c2": (5, 3000.0),
        "t2-r1c1": (1, 123450000.0), "t2-r1c2": (1, 160000000.0), "t2-r2c1": (2, 0.124), "t2-r2c2": (2, 0.13), "t2-r3c1": (3, 3000000.0), "t2-r3c2": (3, 1000.0), "t3-r1c1": (1, 130000000.0), "t5-r1c1": (1, 9.0),
    }
    assert {tuple(r) for r in units.contradictions(values).collect()} == {("t1-r1c1", "t3-r1c1"), ("t2-r1c1", "t3-r1c1"), ("t1-r1c2", "t2-r1c2")}
    assert units.figures(df.limit(0), terms).count() == 0 and units.figures(df, terms.limit(0)).count() == 0


@pytest.mark.parametrize("label,term", [("毛 利 率", 2), ("营業收入", 1), ("EBITDA (调整後)", 3), ("ebitda", 4), ("EBITDA, RMB milion", 4), ("operating cash flows", 7), ("Operatng cash flow（百万元）", 7), ("营业外收入", None), ("毛利", None), ("EBITDA小计", None), ("风险提示", None), ("", None), ("(万元)", None)])
def test_labels_are_read(spark, label, term):
    index = units.term_index(spark.createDataFrame([(1, "营业收入", "money"), (2, "毛利率", "ratio"), (3, "EBITDA（调整后）", "money"), (4, "EBITDA", "money"), (7, "Operating cash flow", "money")], "term_id bigint, term string, measure string").collect())
    found = units.read_label(label, index, units.unit_index())
    assert (found and found[0]) == term


def test_long_text_after_a_number_and_odd_places(spark):
    cells = [(0, 0, "(元)"), (0, 1, "2022"), (0, 1, "2023"), (None, 1, "x"), (1, 1, "5 million yuan (unless otherwise stated)"), (1, 0, "营业收入"), (1, 2, "7"), (2, 0, "EBITDA"), (2, 1, "3"), (2, 1, "4"), (3, 1, "9"), (1_000_000, 0, "EBITDA"), (1_000_000, 1, "8 元")]
    df = spark.createDataFrame([("t", "d", 1, None, 1, [(r, c, t, None, None, 1, 1, None) for r, c, t in cells])], TABLES)
    got = {r.cell_id: (r.year, r.value) for r in units.figures(df, spark.createDataFrame(TERMS, "term_id bigint, term string, measure string")).collect()}
    assert got == {"t-r2c1": (2023, 4.0), "t-r1000000c1": (2023, 8.0), "t-r1c1": (2023, 5e6)}


def test_distance_keeps_scales_apart():
    assert units.weighted_distance("万元", "亿元") >= 3 and units.weighted_distance("RMB mn", "RMB bn") >= 1
    assert units.weighted_distance("kwh", "kWh") < 0.5 and units.weighted_distance("RMB '000", "RMB'000") < 0.2


def test_fold_does_not_change_looks():
    assert fold("m²") == "m²" and fold("CO₂") == "CO₂" and fold("產能") == "產能" and fold(None) is None
    assert json.dumps(fold("Ａ​ｂ")) == '"Ab"'


def test_letters_of_other_alphabets():
    assert fold("ρrοfit") == "profit" and fold("Dіνidend") == "Dividend" and fold("ӏeaѕe") == "lease" and fold("ᎡОІ") == "ROI" and fold("օutput") == "output" and fold("ɡross") == "gross" and fold("ꓣꓳꓲꓚ") == "ROIC"
    assert fold("ı") == "ı" and fold("β") == "β" and fold("д") == "д"
