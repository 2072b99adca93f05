import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from locengine.operators.jobs import corpus_events
from locengine.plans.corpus import translate_corpus, write_corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS = [
    ("a", "md", "# 見出し\n文一\n```\n│ 図   │\n```\n| 名 | x |\n"),
    ("b", "txt", "文一\n文二\n文一"),
    ("c", "txt", "English only"),
    ("d", "pdf", "文"),
]
WORDS = {"# 見出し": "# Heading", "文一": "First", "図": "Fig", "名": "Name", "文二": "Second"}


def model(request):
    """Knows the words above and counts the calls per text by refusing a second batch."""
    return "|||".join(WORDS[t] for t in request.prompt.split("|||"))


def run(spark, **options):
    docs = spark.createDataFrame(DOCS, "doc_id string, file_type string, text string")
    memory = spark.createDataFrame([("文二", "Zwei", 4)], "source string, target string, seq long")
    return translate_corpus(docs, memory, **options)


def test_auto(spark):
    result = run(spark, fn=model)
    texts = {r.doc_id: r.text for r in result.documents.collect()}
    assert texts == {
        "a": "# Heading\nFirst\n```\n│ Fig  │\n```\n| Name | x |\n",
        "b": "First\nZwei\nFirst",
        "c": "English only",
    }
    status = {r.doc_id: (r.status, r.segments_count, r.error) for r in result.status.collect()}
    assert status == {
        "a": ("completed", 4, None),
        "b": ("completed", 3, None),
        "c": ("failed", 0, "no translatable text"),
        "d": ("failed", 0, "unsupported type"),
    }
    assert {(r.text, r.cache_hit) for r in result.segments.filter("doc_id = 'b'").collect()} == {
        ("文一", False), ("文二", True),
    }
    assert {(r.source, r.target, r.seq) for r in result.memory.collect()} == {
        ("文二", "Zwei", 4), *[(s, t, 5) for s, t in WORDS.items() if s != "文二"],
    }
    assert result.exchange is None


def test_a_text_is_sent_once(spark):
    """文一 stands three times in two documents and has one owner."""
    seen = spark.sparkContext.accumulator(0)

    def counting(request):
        seen.add(request.prompt.split("|||").count("文一"))
        return model(request)

    run(spark, fn=counting).segments.count()
    assert seen.value == 1


def test_export_and_blank_export(spark):
    lines = run(spark, fn=model, mode="export").exchange.collect()
    assert sum("<trans-unit" in r.line for r in lines) == 7
    blank = run(spark, mode="no_translate", version="2.1")
    assert blank.documents is None and blank.memory is None
    units = [r.line for r in blank.exchange.collect() if "<unit" in r.line]
    assert len(units) == 7 and all('state="initial"' in u and "<target></target>" in u for u in units)
    assert blank.status.filter("status = 'completed'").count() == 2


def test_import(spark):
    reviewed = spark.createDataFrame(
        [("文一", "Eins", 0), ("名", "Name", 1)], "text string, translated_text string, seq long"
    )
    result = run(spark, mode="import", reviewed=reviewed)
    texts = {r.doc_id: r.text for r in result.documents.collect()}
    assert texts["b"] == "Eins\n文二\nEins"
    assert texts["a"] == "# 見出し\nEins\n```\n│ 図   │\n```\n| Name | x |\n"
    buckets = {r.text: r.bucket for r in result.segments.collect()}
    assert buckets["文二"] == "low" and buckets["名"] != "low"


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        run(spark, mode="other")


PARAGRAPH = (
    "doc_id string, file_type string, part string, kind string, seq long, ordinal int, "
    "runs array<struct<text:string,has_format:boolean,in_link:boolean>>, error string"
)


def test_office_paragraphs(spark):
    part = "word/document.xml"
    sentence = "あ" * 299 + "。"
    paragraphs = spark.createDataFrame(
        [
            ("o", "docx", part, "p", 0, 0, [("文", False, False), ("一", False, False)], None),
            ("o", "docx", part, "p", 1, 2, [("文一", False, False)], None),
            ("o", "docx", part, "p", 2, 3, [(s, True, False) for s in (sentence, "い。") * 3], None),
            ("o", "docx", part, "p", 3, 4, [("plain", False, False)], None),
            ("bad", "docx", None, None, None, None, None, "broken"),
        ],
        PARAGRAPH,
    )
    docs = spark.createDataFrame(
        [*DOCS, ("o", "docx", None), ("bad", "docx", None)], "doc_id string, file_type string, text string"
    )
    memory = spark.createDataFrame([("文二", "Zwei", 4)], "source string, target string, seq long")
    known = WORDS | {sentence + "い。": "Long and short."}

    def answer(request):
        return "|||".join(known[t] for t in request.prompt.split("|||"))

    result = translate_corpus(docs, memory, answer, paragraphs=paragraphs, mode="export")
    rows = result.segments.filter("doc_id = 'o'").orderBy("seq").collect()
    assert [(r.seq, r.location, r.translated_text) for r in rows] == [
        (0, f"{part}:p[0]", "First"), (1, f"{part}:p[3][p0]", "Long and short."),
    ]
    done = {r.ordinal: (r.translated_text, r.match_kind) for r in result.paragraphs.collect()}
    assert done == {
        0: ("First", "exact"),
        # Left out as a duplicate, translated all the same.
        2: ("First", "exact"),
        # Split into pieces, of which equal ones were left out.
        3: ("Long and short." * 3, "untagged_phrase"),
        4: (None, None),
    }
    status = {r.doc_id: (r.status, r.segments_count, r.error) for r in result.status.collect()}
    assert status["o"] == ("completed", 2, None) and status["bad"] == ("failed", 0, "broken")
    assert {r.doc_id for r in result.documents.collect()} == {"a", "b", "c"}
    assert result.exchange.filter("doc_id = 'o' AND line LIKE '<trans-unit%'").count() == 2


def test_a_raising_model_fails_documents_and_no_run(spark):
    def raising(request):
        if "文一" in request.prompt:
            raise KeyError("no such word")
        return model(request)

    result = run(spark, fn=raising)
    status = {r.doc_id: (r.status, r.error) for r in result.status.collect()}
    fault = "KeyError: 'no such word'"
    assert status["a"] == ("failed", fault) and status["b"] == ("failed", fault)
    assert {r.doc_id for r in result.documents.collect()} == {"c"}
    assert sorted((r.doc_id, r.text, r.retry_count, r.error) for r in result.failures.collect()) == [
        ("a", "文一", 3, fault), ("b", "文一", 3, fault), ("b", "文一", 3, fault),
    ]
    # What was translated is kept: another run asks only for the rest.
    assert "文一" not in {r.source for r in result.memory.collect()}
    assert "名" in {r.source for r in result.memory.collect()}


def test_prompts_are_not_shuffled(spark):
    from locengine.operators import batch
    from locengine.operators.inference import translate_batches

    packed = spark.createDataFrame(
        [(1, 0, 0, "md", "文"), (1, 1, 1, "other", "表")],
        "doc_id long, seq long, batch_id long, file_type string, text string",
    )
    calls = translate_batches(
        batch.batch_rows(packed), lambda r: f"{r.system is None}", batch.build_prompts(spark)
    )
    assert "system" not in calls._jdf.queryExecution().executedPlan().toString()
    assert {r.file_type: r.reply for r in calls.collect()} == {"md": "False", "other": "True"}


def test_reviews_stay_in_their_document(spark):
    reviewed = spark.createDataFrame(
        [("a", "文一", "Eins", 0), ("b", "文一", "Uno", 0)],
        "doc_id string, text string, translated_text string, seq long",
    )
    texts = {r.doc_id: r.text for r in run(spark, mode="import", reviewed=reviewed).documents.collect()}
    assert "Eins" in texts["a"] and texts["b"] == "Uno\n文二\nUno"


def test_a_partial_document(spark):
    part = "word/document.xml"
    rows = [
        ("o", "docx", part, "p", 0, 0, [("文一", False, False)], None),
        ("o", "docx", "word/x.xml", None, 1, None, None, "bad checksum"),
        ("o", "docx", "word/y.xml", None, 2, None, None, "bad checksum"),
    ]
    docs = spark.createDataFrame([("o", "docx", None)], "doc_id string, file_type string, text string")
    memory = spark.createDataFrame([], "source string, target string, seq long")
    result = translate_corpus(docs, memory, fn=model, paragraphs=spark.createDataFrame(rows, PARAGRAPH))
    assert [(r.status, r.segments_count, r.error) for r in result.status.collect()] == [
        ("partial", 1, "word/x.xml: bad checksum")
    ]


def test_written_corpus_and_its_events(spark, tmp_path):
    """Outputs and exchange files under their names, and progress that ends with each status."""

    def raising(request):
        if "文二" in request.prompt:
            raise ValueError("no")
        return model(request)

    docs = spark.createDataFrame(DOCS, "doc_id string, file_type string, text string")
    memory = spark.createDataFrame([], "source string, target string, seq long")
    result = translate_corpus(docs, memory, fn=raising, mode="export")
    names = docs.select("doc_id", F.concat(F.lit("in/"), "doc_id", F.lit(".md")).alias("filename"))
    status = {r.doc_id: r for r in write_corpus(result, names, str(tmp_path)).collect()}
    assert {k: r.status for k, r in status.items()} == {
        "a": "completed", "b": "failed", "c": "failed", "d": "failed",
    }
    assert status["a"].output_path == f"{tmp_path}/documents/in/a_vi.md"
    assert open(status["a"].output_path).read().startswith("# Heading")
    assert open(status["a"].xliff_path).read().count("<trans-unit") == 4
    assert (status["b"].output_path, status["d"].xliff_path, status["d"].duration_seconds) == (None, None, None)
    assert status["a"].duration_seconds >= 0
    found = corpus_events(result.calls, result.status).orderBy("ts", "progress").collect()
    events = {}
    for r in found:
        events.setdefault(r.job_id, []).append((r.status, round(r.progress, 3)))
    assert events["c"] == [("failed", 0.0)] and events["a"][-1] == ("completed", 1.0)
    assert sorted(events["a"])[-1] == ("translating", 0.8) and all(r.ts is not None for r in found)
