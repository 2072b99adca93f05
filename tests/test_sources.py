import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locengine.config import new_path, work_dir
from locengine.operators.runs import office_segments
from locengine.plans import fixtures
from locengine.plans.corpus import extract_documents
from locengine.sources import documents, named_files
from locengine.sources.arrow import explode_rows
from locengine.sources.office import office_paragraphs, read_office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def docx():
    run = "<w:r>{0}<w:t>{1}</w:t></w:r>"
    bold = "<w:rPr><w:b/></w:rPr>"
    return package(
        {
            "word/document.xml": f"<w:document {W}><w:body>"
            f"<w:p>{run.format('', 'これは')}{run.format(bold, '重要')}{run.format('', 'です')}</w:p>"
            f"<w:p>{run.format('', '文')}{run.format('', '[1]')}"
            f"<w:hyperlink>{run.format('', '26_M9')}</w:hyperlink></w:p>"
            f"<w:p>{run.format('', 'これは')}{run.format(bold, '重要')}{run.format('', 'です')}</w:p>"
            "<w:p/><w:p><w:r><w:t></w:t></w:r></w:p></w:body></w:document>",
            "word/header1.xml": f"<w:hdr {W}><w:p>{run.format('', '見出し')}</w:p></w:hdr>",
            "word/broken.xml": "<w:document>",
            "other/item.xml": f"<w:hdr {W}><w:p>{run.format('', '外')}</w:p></w:hdr>",
        }
    )


def xlsx():
    return package(
        {
            "xl/sharedStrings.xml": f"<sst {S}><si><t>合計</t></si><si><t>x</t></si>"
            "<si><r><t>一</t></r><r><rPr/><t>二</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData><row><c t='s'><v>0</v></c>"
            "<c t='inlineStr'><is><t>内</t></is></c></row></sheetData></worksheet>",
            "xl/drawings/drawing1.xml": f"<d {A}><a:p><a:r><a:rPr/><a:t>図</a:t></a:r></a:p></d>",
            "xl/workbook.xml": f"<workbook {S}><sheets><sheet name='計画'/><sheet name='B'/></sheets></workbook>",
        }
    )


def pptx():
    slide = f"<s {A}><a:p><a:r><a:t>題</a:t></a:r></a:p><a:p><a:r><a:t>[1]</a:t></a:r></a:p></s>"
    return package({"ppt/slides/slide1.xml": slide, "ppt/media/x.bin": "題"})


def segments(spark, file_type, content):
    df = spark.createDataFrame([("f", file_type, bytearray(content))], "doc_id string, file_type string, content binary")
    rows = office_segments(office_paragraphs(df)).filter("text IS NOT NULL").orderBy("seq", "piece").collect()
    return [(r.type, r.location, r.text) for r in rows]


def test_docx(spark):
    assert segments(spark, "docx", docx()) == [
        ("body", "word/document.xml:p[0]", "これは<tag1>重要</tag1>です"),
        ("body", "word/document.xml:p[1]", "文"),
        ("body", "word/header1.xml:p[0]", "見出し"),
    ]


def test_xlsx(spark):
    assert segments(spark, "xlsx", xlsx()) == [
        ("sheet_name", "xl/workbook.xml:sheet[0]", "計画"),
        ("body", "xl/sharedStrings.xml:si[0]", "合計"),
        ("body", "xl/sharedStrings.xml:si[2]", "一<tag1>二</tag1>"),
        ("body", "xl/worksheets/sheet1.xml:is[1]", "内"),
        ("drawing", "xl/drawings/drawing1.xml:p[0]", "<tag1>図</tag1>"),
    ]


def test_pptx(spark):
    assert segments(spark, "pptx", pptx()) == [("body", "ppt/slides/slide1.xml:p[0]", "題")]


def test_reading_and_errors(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pptx").write_bytes(pptx())
    (tmp_path / "c.xlsx").write_bytes(b"no package")
    (tmp_path / "d.exe").write_bytes(b"x")
    found = read_office(spark, str(tmp_path))
    texts = spark.createDataFrame(
        [("t", "md", "文"), ("u", "pdf", "文"), ("v", None, "文")],
        "doc_id string, file_type string, text string",
    )
    rows = extract_documents(texts, found).collect()
    by_name = {}
    for r in rows:
        by_name.setdefault(r.doc_id.rsplit("/", 1)[-1], []).append(r)
    assert set(by_name) == {"a.DOCX", "b.pptx", "c.xlsx", "t", "u", "v"}
    assert [r.error is None for r in sorted(by_name["a.DOCX"], key=str)].count(True) == 3
    assert "zip" in by_name["c.xlsx"][0].error and by_name["c.xlsx"][0].text is None
    assert [by_name[n][0].error for n in "tuv"] == [None, "unsupported type", "unsupported type"]


def test_types_and_names(spark):
    names = ["a.docx", "x/B.XLSX", "c.tar.md", "d.exe", "plain", ".md", "", None, "dir.md/file", "e.Csv"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    rows = df.select(
        documents.detect_file_type(F.col("path")).alias("t"), documents.output_name(F.col("path")).alias("n")
    ).collect()
    assert [r.t for r in rows] == ["docx", "xlsx", "md", None, None, None, None, None, None, "csv"]
    assert [r.n for r in rows][:6] == [
        "a_vi.docx", "B_vi.XLSX", "c.tar_vi.md", "d_vi.exe", "plain_vi", ".md_vi",
    ]
    listed = documents.list_documents(df.filter("path IS NOT NULL"))
    assert [r.path for r in listed.collect()] == ["x/B.XLSX", "a.docx", "c.tar.md", "e.Csv"]


def test_written_documents(spark, tmp_path):
    """One file per document, under its name and in its folder, and nothing else."""
    rows = [("in/a.md", "一\n二"), ("other/a.md", "三\n"), ("file:/x/b.txt", ""), ("/y/c", None)]
    df = spark.createDataFrame(rows, "filename string, text string").repartition(3)
    out = tmp_path / "out"
    documents.write_documents(df, str(out))
    found = {str(f.relative_to(out)): f.read_text() for f in out.rglob("*") if f.is_file()}
    assert found == {
        "_SUCCESS": "", "in/a_vi.md": "一\n二", "other/a_vi.md": "三\n", "x/b_vi.txt": "", "y/c_vi": "",
    }
    with pytest.raises(Exception, match="FileExistsError"):
        documents.write_documents(df, str(out))
    documents.write_documents(df.withColumn("text", F.lit("new")), str(out), overwrite=True)
    assert (out / "in/a_vi.md").read_text() == "new"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    twice = spark.createDataFrame([("a.md", "1"), ("/a.md", "2")], "filename string, text string")
    with pytest.raises(ValueError, match="more than once"):
        documents.write_documents(twice, str(tmp_path / "out"))
    outside = spark.createDataFrame([("a.md", "1"), ("../b.md", "2")], "filename string, text string")
    with pytest.raises(Exception, match="not a file name"):
        documents.write_documents(outside.repartition(2), str(tmp_path / "out"))
    assert [f for f in (tmp_path / "out").rglob("*") if f.is_file()] == []


@pytest.mark.parametrize(
    "text, charset, expected",
    [
        ("日本語テキスト", "utf-8", "utf-8"),
        ("テストデータ", "shift_jis", "cp932"),
        ("漢字テスト", "euc_jp", "euc_jp"),
        ("これは日本語の文章です。", "shift_jis", "cp932"),
        ("これは日本語の文章です。", "euc_jp", "euc_jp"),
        ("①㈱テスト", "cp932", "cp932"),
        ("日本語テキスト", "utf-8-sig", "utf-8"),
        ("これは日本語の文章です。", "iso2022_jp", "iso2022_jp"),
        ("日本語 text", "utf-16", "utf-16"),
        ("\x1b[1mbold é", "utf-8", "utf-8"),
        ("", "utf-8", "utf-8"),
        ("plain ascii", "ascii", "utf-8"),
        ("café", "cp1252", "cp1252"),
        ("Crème brûlée, très “bon” – 12 €\n", "cp1252", "cp1252"),
        ("Größe und Straße", "latin-1", "cp1252"),
        ("日本語のテキスト", "utf-16-le", "utf-16-le"),
        ("ニケトの表\n", "utf-16-be", "utf-16-be"),
        ("あいう", "utf-16-le", "utf-16-le"),
        ("plain text", "utf-16-le", "utf-16-le"),
        ("a\x00b, valid", "utf-8", "utf-8"),
        ("100000", "utf-8", "utf-8"),
        ("サービス", "cp932", "cp932"),
        ("10年間のサービス利用規約", "euc_jp", "euc_jp"),
    ],
)
def test_decoding(spark, text, charset, expected):
    df = spark.createDataFrame([("f", bytearray(text.encode(charset)))], "path string, content binary")
    row = documents.decode_corpus(df).head()
    assert (row.text, row.encoding) == (text, expected)


def test_undecodable_bytes_are_replaced(spark):
    df = spark.createDataFrame([("f", bytearray(b"a\xff\xfe\xfd\x01"))], "path string, content binary")
    decoded = documents.decode_corpus(df)
    assert decoded.head().text.startswith("a�")
    assert [tuple(r) for r in documents.encoding_report(decoded).collect()] == [("unknown", 1)]


def test_small_sources_are_spread_and_large_ones_left_alone(spark):
    one = spark.range(100).coalesce(1)
    assert documents.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 9)
    assert documents.spread(many) is many


def test_rows_are_sent_in_batches(spark):
    df = spark.range(3)
    out = explode_rows(
        df, lambda r: ({"id": r["id"] * 10_000 + i} for i in range(5000)), df.schema
    )
    assert out.count() == 15_000 and out.distinct().count() == 15_000


def test_work_dir_is_read_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark) == root
    assert new_path(spark, "x").startswith(root) and new_path(spark, "x") != new_path(spark, "x")


def test_work_dir_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())


def test_a_local_session_needs_no_setting():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local[2]"}.get(key, default)

    class Context:
        applicationId = "local-test"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert work_dir(Session()) == work_dir(Session()) and "locengine-" in work_dir(Session())


def test_a_bad_part_costs_its_own_row(spark):
    """Checksums, encryption, unknown packing and markup that is cut: other parts are read."""
    para = "<w:p><w:r><w:t>文{0}</w:t></w:r></w:p>"
    parts = {f"word/p{i}.xml": f"<w:document {W}>{para.format(i)}</w:document>" for i in range(6)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    raw = bytearray(out.getvalue())
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = {i.filename: i for i in z.infolist()}
    directory, at = {}, 0
    for name in parts:
        at = raw.index(b"PK\x01\x02", at) + 4
        directory[name] = at - 4
    raw[directory["word/p1.xml"] + 16] ^= 1  # checksum
    raw[directory["word/p2.xml"] + 8] |= 1  # encrypted
    raw[directory["word/p3.xml"] + 10] = 97  # packed by a method that nothing reads
    raw[infos["word/p4.xml"].header_offset + 45] ^= 255  # packed bytes
    schema = "doc_id string, file_type string, content binary"
    files = [("f", "docx", raw), ("cut", "docx", raw[:200]), ("other", "pdf", raw), ("null", "docx", None)]
    rows = office_paragraphs(spark.createDataFrame(files, schema)).collect()
    own = {r.part: r for r in rows if r.doc_id == "f"}
    assert set(own) == set(parts)
    assert [own[f"word/p{i}.xml"].error is None for i in range(6)] == [True, False, False, False, False, True]
    assert own["word/p5.xml"].runs[0].text == "文5" and own["word/p0.xml"].seq < own["word/p5.xml"].seq
    faults = [r for r in rows if r.doc_id != "f"]
    assert sorted(r.doc_id for r in faults) == ["cut", "null", "other"] and all(r.error for r in faults)


def test_parts_are_chosen_by_content_type(spark):
    kind = "application/vnd.openxmlformats-officedocument"
    types = (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        f'<Override PartName="/odd/main.xml" ContentType="{kind}.wordprocessingml.document.main+xml"/>'
        '<Override PartName="/word/theme.xml" ContentType="application/xml"/></Types>'
    )
    body = f"<w:document {W}><w:p><w:r><w:t>文</w:t></w:r></w:p></w:document>"
    content = package({"[Content_Types].xml": types, "word/theme.xml": body, "odd/main.xml": body})
    assert segments(spark, "docx", content) == [("body", "odd/main.xml:p[0]", "文")]


def test_inputs_keep_their_texts(spark):
    """Marks are added to the inputs of the queries; without them the documents come back."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in fixtures.documents(spark, d).collect()}
    lines = {}
    for r in fixtures.paragraphs(spark, d).collect():
        words = [x.text for x in r.runs if x.text != "[1]"]
        assert len(r.runs) - len(words) == sum(i % 9 == 4 for i in range(len(words)))
        lines.setdefault(r.doc_id, {})[r.ordinal] = "".join(words)[:-1]
    assert {k: "\n".join(v[i] for i in sorted(v)) for k, v in lines.items()} == texts
    back = str.maketrans(fixtures.KANA, fixtures.ACCENTED)
    for r in documents.decode_corpus(fixtures.byte_files(spark, d)).collect():
        assert r.text.translate(back) == texts[r.doc_id]


def test_batches_of_long_bytes_are_small():
    """Rows with long bytes are sent on before there are many of them."""
    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    schema = T.StructType().add("i", "integer").add("packed", "binary")
    run = explode_rows(Frame(), lambda row: ({"i": k, "packed": b"x" * (1 << 20)} for k in range(row["n"])), schema)
    sent = list(run(iter([pa.RecordBatch.from_pylist([{"n": 20}, {"n": 3}])])))
    assert [k for b in sent for k in b.column(0).to_pylist()] == [*range(20), *range(3)]
    assert max(b.nbytes for b in sent) < 8 << 20


def test_named_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Files of all levels, with few and with many folders, but hidden ones and other endings."""
    names = {f"{a}/{b}/{c}.md": f"{a}{b}{c}é" for a in "xy" for b in "pqr" for c in (1, 2)}
    names |= {"top.md": "", "x/a b%20.md": "t", "x/p/_no.md": "h", ".hidden/no.md": "h", "x/other.txt": "o"}
    for name, text in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    wanted = {n: t.encode() for n, t in names.items() if t not in ("h", "o")}
    for folders in (1, 2, 3, 256):
        monkeypatch.setattr(named_files, "FOLDERS", folders)
        found = named_files.read_named(spark, str(tmp_path), ".md").collect()
        assert len(found) == len(wanted) and {r["name"]: bytes(r["content"]) for r in found} == wanted
