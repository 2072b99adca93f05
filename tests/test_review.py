import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from locengine.operators import review
from locengine.sources.xliff import read_xliff, xliff_rows, xliff_segments

SEGMENT = (
    "doc_id long, seq long, location string, type string, text string, translated_text string, "
    "confidence double, xliff_state string"
)
ROWS = [
    (1, 0, "line[0]", "body", "文 A & B < C", None, None, None),
    (1, 1, "line[1]", "body", "文", "Câu \"x\"", 0.4, None),
    (1, 2, "line[2]", "body", "  ", "skipped", 0.9, None),
    (1, 3, "line[3]", "body", "text<tag1>bold</tag1>more<tag2/>break", "a<tag1>b</tag1>&<tag2/>", 0.95, None),
    (1, 4, "line[4]", "body", "終", "hết", 0.9, "final"),
    (2, 0, "x.xml:p[0]", "body", "<tag1>開いた", "mở &lt; ]]>", 0.856, None),
]
DOCS = [(1, "a & b.md", "md"), (2, "<c>.docx", "docx"), (3, "unused.md", "md")]


def exported(spark, version, **options):
    segments = spark.createDataFrame(ROWS, SEGMENT)
    documents = spark.createDataFrame(DOCS, "doc_id long, filename string, file_type string")
    return review.xliff_lines(segments, documents, version, **options)


def test_files_are_valid(spark):
    ns = review.NAMESPACE
    files = {r.doc_id: r.content for r in review.xliff_documents(exported(spark, "1.2")).collect()}
    assert set(files) == {1, 2}
    root = ET.fromstring(files[1].encode())
    assert root.get("version") == "1.2"
    head = root.find(f"{{{ns['1.2']}}}file")
    assert (head.get("original"), head.get("datatype")) == ("a & b.md", "x-md")
    units = list(root.iter(f"{{{ns['1.2']}}}trans-unit"))
    assert [u.get("id") for u in units] == ["1", "2", "4", "5"]
    targets = [u.find(f"{{{ns['1.2']}}}target") for u in units]
    assert [t.get("state") for t in targets] == [
        "new", "needs-review-translation", "translated", "final",
    ]
    notes = [n.text for n in units[1].findall(f"{{{ns['1.2']}}}note")]
    assert notes == ["location: line[1]", "type: body", "confidence: 0.40"]
    second = {r.doc_id: r.content for r in review.xliff_documents(exported(spark, "2.1")).collect()}
    root = ET.fromstring(second[2].encode())
    assert (root.get("srcLang"), root.get("trgLang")) == ("ja", "vi")
    assert [u.get("id") for u in root.iter(f"{{{ns['2.1']}}}unit")] == ["u1"]


EXPECTED = [
    (1, "文 A & B < C", "", "new", "line[0]", None),
    (1, "文", "Câu \"x\"", "needs-review-translation", "line[1]", 0.4),
    (1, ROWS[3][4], ROWS[3][5], "translated", "line[3]", 0.95),
    (1, "終", "hết", "final", "line[4]", 0.9),
    (2, "<tag1>開いた", "mở &lt; ]]>", "translated", "x.xml:p[0]", 0.86),
]


def test_round_trip(spark):
    for version in ("1.2", "2.1"):
        files = review.xliff_documents(exported(spark, version))
        out = xliff_segments(files).orderBy("doc_id", "unit_no").collect()
        assert [
            (r.doc_id, r.text, r.translated_text, r.xliff_state, r.location, r.confidence)
            for r in out
        ] == EXPECTED
        assert {r.version for r in out} == {version} and {r.type for r in out} == {"body"}


def test_written_files(spark, tmp_path):
    """One file per document under its name, its lines in order; nothing else is left."""
    path = str(tmp_path / "exchange")
    documents = spark.createDataFrame(
        [(1, "one/a & b.md"), (2, "two/a & b.md")], "doc_id long, filename string"
    )
    review.write_xliff(exported(spark, "2.1"), documents, path)
    made = sorted(str(f.relative_to(path)) for f in (tmp_path / "exchange").rglob("*") if f.is_file())
    assert made == ["_SUCCESS", "one/a & b.md.xlf", "two/a & b.md.xlf"]
    out = read_xliff(spark, path).collect()
    assert sorted((r.text, r.translated_text) for r in out) == sorted((e[1], e[2]) for e in EXPECTED)
    assert len({r.doc_id for r in out}) == 2 and not any(r.error for r in out)
    same = documents.withColumn("filename", F.lit("a.md"))
    with pytest.raises(ValueError, match="more than once"):
        review.write_xliff(exported(spark, "2.1"), same, str(tmp_path / "other"))
    several = str(tmp_path / "several")
    review.write_xliff(exported(spark, "1.2", units_per_file=2), documents, several, several=True)
    assert len(list((tmp_path / "several").rglob("*.xlf"))) == 4
    assert read_xliff(spark, several).count() == len(EXPECTED)


def test_faults_of_files_are_rows(spark):
    """Units before a fault are kept, and other files are not touched."""
    ns = review.NAMESPACE["1.2"]
    unit = '<trans-unit id="1"><source>A</source><target state="final">B</target></trans-unit>'
    good = f'<xliff version="1.2" xmlns="{ns}"><file><body>{unit}{unit}</body></file></xliff>'
    files = [
        ("good", good), ("cut", good[: good.rindex("<trans-unit") + 30]), ("empty", ""), ("null", None),
        ("other", "<html><body/></html>"), ("text", "no markup"), ("charset", '<?xml version="1.0" encoding="nope"?><a/>'),
        ("long", good.replace("A", "x" * 200_000)),
    ]
    rows = xliff_rows(spark.createDataFrame(files, "doc_id string, content string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.text, r.translated_text, r.xliff_state, r.error is not None))
    fault = (None, None, None, True)
    assert found["good"] == [("A", "B", "final", False)] * 2
    assert found["cut"] == [("A", "B", "final", False), fault]
    assert found["long"] == [("x" * 200_000, "B", "final", False)] * 2
    assert all(found[n] == [fault] for n in ("empty", "null", "other", "text", "charset"))


def test_inline_elements_of_any_shape(spark):
    body = (
        '<source>a<bpt rid="7" ctype="x/y" id="7"><sub>s</sub></bpt>b<ept id="8" rid="7"/>'
        'c<x ctype="image/png" id="2"/>&lt;b&gt; &amp;amp;<g id="k">d<mrk mtype="term">e</mrk></g>'
        '<x id="0007" ctype="x-cp-0007"/><!-- c --><![CDATA[<i>]]></source>'
    )
    first = (
        f'<xliff xmlns="{review.NAMESPACE["1.2"]}"><file><body><trans-unit id="1">{body}'
        f'<target><g id="k">t</g></target></trans-unit></body></file></xliff>'
    )
    assert parsed(spark, first) == [
        ("1.2", "a<tag7>b</tag7>c<tag2/><b> &amp;<tag1001>de</tag1001>\x07<i>", "<tag1001>t</tag1001>", None)
    ]
    second = (
        '<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0"><file id="f"><group id="g"><unit id="u"><notes>'
        '<note>location: line[3]</note></notes><segment state="final"><source>a<sc type="fmt" id="4"/>b'
        '<ec startRef="4"/><ph dataRef="d/1" id="5"/><cp hex="001F"/></source></segment></unit></group></file></xliff>'
    )
    assert parsed(spark, second) == [("2.0", "a<tag4>b</tag4><tag5/>\x1f", "", "final")]


def test_any_text_survives_the_exchange(spark):
    texts = ["a\x00b\x1f", "\r\n\r", "]]>", "&#13;", "<tag1>x", "<pc id=\"1\">", "\ufffe", "&lt;", "<b>&amp;</b>", "x\x0by"]
    rows = [(1, i, None, None, t, t, None, None) for i, t in enumerate(texts)]
    documents = spark.createDataFrame([(1, "a\x01.md", "md")], "doc_id long, filename string, file_type string")
    for version in ("1.2", "2.1"):
        lines = review.xliff_lines(spark.createDataFrame(rows, SEGMENT), documents, version)
        back = xliff_rows(review.xliff_documents(lines)).orderBy("unit_no").collect()
        blank = [t for t in texts if not t.strip()]
        assert [r.text for r in back] == [t for t in texts if t not in blank]
        assert [r.translated_text for r in back] == [r.text for r in back] and not any(r.error for r in back)


def test_large_documents_become_several_files_on_request(spark):
    whole = review.xliff_documents(exported(spark, "1.2")).orderBy("doc_id").collect()
    assert [(f.doc_id, f.file_no) for f in whole] == [(1, 0), (2, 0)]
    lines = exported(spark, "1.2", units_per_file=2)
    files = review.xliff_documents(lines).orderBy("doc_id", "file_no").collect()
    assert [(f.doc_id, f.file_no) for f in files] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    for f in files:
        ET.fromstring(f.content.encode())


def parsed(spark, content):
    rows = spark.createDataFrame([("f", content)], "doc_id string, content string")
    return [
        (r.version, r.text, r.translated_text, r.xliff_state) for r in xliff_segments(rows).collect()
    ]


def test_files_of_other_tools(spark):
    first = (
        '<x:xliff xmlns:x="urn:oasis:names:tc:xliff:document:1.2"><x:file><x:body>'
        '<x:trans-unit id="9"><x:source>A<x:bpt id="1" ctype="b">&lt;tag1&gt;</x:bpt>B'
        '<x:ept id="1">&lt;/tag1&gt;</x:ept><x:x id="2"/> &amp;amp;</x:source></x:trans-unit>'
        "</x:body></x:file></x:xliff>"
    )
    assert parsed(spark, first) == [("1.2", "A<tag1>B</tag1><tag2/> &amp;", "", None)]
    second = (
        '<xliff version="2.1" xmlns="urn:oasis:names:tc:xliff:document:2.1"><file id="f"><unit id="u">'
        '<segment state="reviewed"><source>A</source><target><pc id="3">B</pc></target></segment>'
        "<segment><source>C</source><target> </target></segment></unit></file></xliff>"
    )
    assert parsed(spark, second) == [
        ("2.1", "A", "<tag3>B</tag3>", "needs-review-translation"), ("2.1", "C", "", None),
    ]
