from pyspark.sql import functions as F

from locengine.operators import extract, runs
from locengine.functions.text import tag_list

DOC = "doc_id string, text string"


def segments(spark, text):
    df = extract.extract_text(spark.createDataFrame([("d", text)], DOC))
    rows = df.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [(r.type, r.location, r.cell_index, r.text) for r in rows]


def test_body_lines(spark):
    assert segments(spark, "日本語テキスト\nEnglish only\nテスト二行目") == [
        ("body", "line[0]", None, "日本語テキスト"),
        ("body", "line[2]", None, "テスト二行目"),
    ]


def test_code_is_skipped(spark):
    text = "# タイトル\n```python\n# コメント\n```\nテスト\n"
    assert segments(spark, text) == [
        ("body", "line[0]", None, "# タイトル"),
        ("body", "line[4]", None, "テスト"),
    ]


def test_duplicates_stay(spark):
    assert len(segments(spark, "テスト\nテスト")) == 2


def test_diagram_tokens(spark):
    text = "題\n```\n┌──┐\n│ サービス 管理 │ ナレッジ │ API\n```\nテスト"
    assert segments(spark, text) == [
        ("body", "line[0]", None, "題"),
        ("diagram_token", "line[3]", None, "サービス 管理"),
        ("diagram_token", "line[3]", None, "ナレッジ"),
        ("body", "line[5]", None, "テスト"),
    ]


def test_marks_alone_are_no_tokens(spark):
    assert segments(spark, "```\n│ ・ー │ 表 │\n```") == [("diagram_token", "line[1]", None, "表")]


def test_table_cells(spark):
    assert segments(spark, "| 名前 | value | 値 |\n|---|---|---|\n|") == [
        ("table_cell", "line[0]", 0, "名前"),
        ("table_cell", "line[0]", 2, "値"),
    ]


def test_fences(spark):
    # An unclosed last fence opens nothing, and fences do not nest.
    assert segments(spark, "```\nテスト") == [("body", "line[1]", None, "テスト")]
    assert segments(spark, "```\n一\n```\n二\n```\n三\n```\n四\n```\n五") == [
        ("body", "line[3]", None, "二"),
        ("body", "line[7]", None, "四"),
        ("body", "line[9]", None, "五"),
    ]
    assert segments(spark, "  ```\n一\n　```\n二") == [("body", "line[3]", None, "二")]
    # Other fence marks are ordinary lines.
    assert segments(spark, "~~~\n一\n~~~") == [("body", "line[1]", None, "一")]


def test_line_marks(spark):
    df = spark.createDataFrame([("d", "a\n```\nx + y\n```\n```\nz\n```\n```\nb")], DOC)
    rows = extract.mark_lines(df).orderBy("line_idx").collect()
    assert [(r.line_idx, r.inside, r.is_diagram) for r in rows] == [
        (0, False, False),
        (2, True, True),
        (5, True, False),
        (8, False, False),
    ]


def test_counts_include_documents_without_segments(spark):
    docs = spark.createDataFrame([("a", "一\n二"), ("b", "none")], DOC)
    rows = extract.segment_counts(docs, extract.extract_text(docs)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [("a", "body", 2, "extracted"), ("b", None, 0, "failed")]


def test_dedup_keeps_the_first(spark):
    rows = [("d", 0, " 一", "x"), ("d", 1, "一", "y"), ("d", 2, "二", "z"), ("e", 5, "一", "w")]
    df = spark.createDataFrame(rows, "doc_id string, seq long, text string, location string")
    out = extract.dedup_segments(df).orderBy("doc_id", "seq").collect()
    assert [tuple(r) for r in out] == [rows[0], rows[2], rows[3]]


PARAGRAPH = (
    "doc_id string, part string, kind string, seq long, ordinal int, "
    "runs array<struct<text:string,has_format:boolean,in_link:boolean>>"
)


def paragraph(spark, *paragraphs, part="word/document.xml"):
    rows = [("d", part, "p", i, i, list(p)) for i, p in enumerate(paragraphs)]
    return spark.createDataFrame(rows, PARAGRAPH)


def test_tagged_runs(spark):
    df = paragraph(
        spark,
        [("これは", False, False), ("重要", True, False), ("です", False, False), ("太", True, False)],
        [("[1]", False, False), ("文", False, False), (" [2] ", True, False), ("30", True, False)],
        [("文", False, False), ("26_M9_JM7", False, True)],
        [("English", False, False)],
    )
    out = runs.tag_runs(runs.drop_noise_runs(df)).orderBy("seq").collect()
    assert [(r.location, r.type, r.text) for r in out] == [
        ("word/document.xml:p[0]", "body", "これは<tag1>重要</tag1>です<tag2>太</tag2>"),
        ("word/document.xml:p[1]", "body", "文<tag1>30</tag1>"),
        ("word/document.xml:p[2]", "body", "文"),
    ]


def test_noise_stays_outside_word_processing(spark):
    df = paragraph(spark, [("[1]", False, False), ("文", False, False)], part="ppt/slides/slide1.xml")
    assert [r.text for r in runs.tag_runs(runs.drop_noise_runs(df)).collect()] == ["[1]文"]


def test_heavy_tags_are_stripped_and_split(spark):
    sentence = "あ" * 149 + "。"
    heavy = [(sentence, True, False)] * 5
    light = [("字", True, False)] * 4
    df = paragraph(spark, heavy, light, light)
    out = runs.office_segments(df).orderBy("seq", "piece").collect()
    assert [(r.seq, r.piece, r.location) for r in out] == [
        (0, 0, "word/document.xml:p[0][p0]"),
        # The second and third piece: one of two sentences, equal to the first, is a duplicate.
        (0, 2, "word/document.xml:p[0][p2]"),
        (1, None, "word/document.xml:p[1]"),
    ]
    assert out[0].text == sentence * 2 and out[1].text == sentence
    assert out[2].text.count("<tag") == 4
    slides = paragraph(spark, heavy, part="ppt/slides/slide1.xml")
    only = runs.office_segments(slides).collect()
    assert len(only) == 1 and only[0].text.count("<tag") == 5


def test_run_boundaries(spark):
    texts = [("trồng trọt", True, False), ("và", False, False), (" giống", True, False), ("1", False, False)]
    df = paragraph(spark, texts)
    out = df.select(runs.fix_run_boundaries(F.col("runs")).alias("t")).head().t
    assert out == ["trồng trọt ", "và ", " giống", "1"]


def test_paragraph_fallback(spark):
    df = spark.createDataFrame(
        [("d", 0, "a<tag1>b</tag1>"), ("d", 1, "c<tag1>d</tag1>"), ("d", 2, "e"), ("x", 3, "e")],
        "doc_id string, seq long, text string",
    )
    tmap = spark.createDataFrame(
        [("d", "a<tag1>b</tag1>", "A"), ("d", "cd", "C"), ("x", "e", "E")],
        "doc_id string, source string, target string",
    )
    out = runs.match_paragraphs(df, tmap).orderBy("seq").collect()
    assert [(r.translated_text, r.match_kind) for r in out] == [
        ("A", "tagged"), ("C", "plain"), (None, None), ("E", "tagged"),
    ]


def test_tag_list_is_a_multiset(apply):
    assert apply(["<tag2>a</tag2><tag1>"], tag_list(F.col("text"))) == [["</tag2>", "<tag1>", "<tag2>"]]
