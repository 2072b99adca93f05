import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from locengine.config import Limits
from locengine.operators import batch
from locengine.operators.inference import python_class, translate_batches, translate_with_retries
from locengine.functions.text import PROFILES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKED = "doc_id string, seq long, batch_id long, file_type string, text string"


def packed(spark, *texts):
    rows = [("d", i, b, "docx", s) for i, (b, s) in enumerate(texts)]
    return spark.createDataFrame(rows, PACKED)


def test_glossary(spark):
    terms = spark.createDataFrame(
        [(2, "乙", "B", None), (1, "甲", "A", "x"), (7, "丙", "C", "")],
        "id long, jp string, vi string, context string",
    )
    whole = batch.glossary_text(terms)
    assert whole.index("| 甲 | A | x |") < whole.index("| 乙 | B |  |") < whole.index("| 丙 | C |  |")
    assert batch.glossary_text(None) == "" and batch.glossary_text(terms.filter("false")) == ""
    apart = terms.withColumn("id", F.col("id") * 100_000).withColumn("vi", F.repeat("vi", 70_000))
    whole = batch.glossary_text(apart)
    assert whole.count(batch.GLOSSARY_HEAD) == whole.count(batch.GLOSSARY_TAIL) == 1
    assert len(whole) > 210_000
    with pytest.raises(ValueError, match="does not fit"):
        batch.glossary_text(apart, max_chars=65_536)


def test_prompts(spark):
    prompts = {r.file_type: r.system for r in batch.build_prompts(spark).collect()}
    assert set(prompts) == {"docx", "xlsx", "pptx", "pdf", "md", "txt", "csv"}
    assert all(batch.DELIMITER in p for p in prompts.values())
    assert "<tag1>" in prompts["xlsx"] and "<tag1>" not in prompts["md"]


def test_retry_warnings(apply):
    pairs = [("<tag1>a</tag1>", 1), ("<tag1>a</tag1>", 2), ("a", 3)]
    out = apply(pairs, batch.retry_warning(F.col("t"), F.col("n")), "t string, n int")
    assert out[0] == ""
    assert batch.TAG_WARNING + "<tag1> </tag1>" in out[1] and batch.LEAK_WARNING in out[1]
    assert out[2] == "\n\n" + batch.LEAK_WARNING


def routes(spark, reply, *texts):
    entries = [(i, s) for i, s in enumerate(texts)]
    df = spark.createDataFrame(
        [("d", 0, entries, reply)],
        "doc_id string, batch_id long, entries array<struct<seq:long,text:string>>, reply string",
    )
    rows = batch.route_replies(df).orderBy("seq").collect()
    return [(r.translated_text, r.route) for r in rows]


def test_routing(spark):
    assert routes(spark, " Dịch A ||| Dịch B \n", "文", "章") == [
        ("Dịch A", "accept"), ("Dịch B", "accept"),
    ]
    assert routes(spark, "a|||b|||c", "文", "章") == [(None, "count"), (None, "count")]
    assert routes(spark, "Dịch 文|||B", "文", "章") == [("Dịch 文", "leak"), ("B", "accept")]
    assert routes(spark, "bold", "<tag1>文</tag1>") == [("bold", "tags")]
    assert routes(spark, None, "文", "章") == [("文", "timeout"), ("章", "timeout")]
    # An empty piece is a piece; a kept mark is no leak.
    assert routes(spark, "|||・B", "文", "章") == [("", "accept"), ("・B", "accept")]


def test_count_check(spark):
    df = spark.createDataFrame(
        [
            ("d", 0, [(0, "a"), (1, "b")], "x|||y"),
            ("d", 1, [(2, "c")], "x|||y"),
            ("d", 2, [(3, "e")], None),
        ],
        "doc_id string, batch_id long, entries array<struct<seq:long,text:string>>, reply string",
    )
    assert tuple(batch.check_batches(df).head()) == ("d", 3, 4, 4, 2, 1)


def answer(request):
    """Batch calls spoil some segments; single calls need a given number of attempts."""
    if request.attempt == 0:
        if "timeout" in request.prompt:
            raise TimeoutError
        if "many" in request.prompt:
            return request.prompt + "|||x"
        return "|||".join(t if "文" in t else t.upper() for t in request.prompt.split("|||"))
    needed = {"文1": 1, "文2": 2, "文9": 9}.get(request.prompt, 1)
    if request.prompt == "文0":
        raise TimeoutError
    if request.attempt > 1:
        assert batch.LEAK_WARNING in request.system
    assert request.temperature == pytest.approx(0.2)
    return f" ok {request.attempt}" if request.attempt >= needed else request.prompt


def test_retries(spark):
    df = packed(
        spark, (0, "a"), (0, "文2"), (0, "文1"), (1, "文9"), (2, "timeout"), (2, "b"), (3, "many"),
        (3, "<tag1>q</tag1>"), (4, "文0"),
    )
    out = translate_with_retries(df, batch.build_prompts(spark), answer).orderBy("seq").collect()
    assert [(r.translated_text, r.retry_count, r.status) for r in out] == [
        ("A", 0, "accepted"),
        ("ok 2", 2, "accepted"),
        ("ok 1", 1, "accepted"),
        ("文9", 3, "best_effort"),
        ("timeout", 0, "timeout"),
        ("b", 0, "timeout"),
        ("ok 1", 1, "accepted"),
        ("ok 3", 3, "best_effort"),
        ("文0", 3, "best_effort"),
    ]


def test_retry_limit(spark):
    df = packed(spark, (0, "文2"))
    out = translate_with_retries(
        df, batch.build_prompts(spark), answer, limits=Limits(max_retries=1)
    ).head()
    assert (out.translated_text, out.retry_count, out.status) == ("文2", 1, "best_effort")


def test_concurrency_sets_the_parallel_calls(spark):
    rows = batch.batch_rows(packed(spark, (0, "a"), (1, "b")))
    calls = translate_batches(rows, answer, batch.build_prompts(spark), concurrency=3)
    assert calls.rdd.getNumPartitions() == 3


def test_python_class_matches_the_same_characters(apply):
    import re

    for p in PROFILES.values():
        pattern = re.compile(f"[{python_class(p.leak)}]")
        sample = [chr(c) for c in range(0x80, 0xFFFF, 53) if not 0xD800 <= c < 0xE000]
        expected = [bool(pattern.search(c)) for c in sample]
        assert apply(sample, F.col("text").rlike(f"[{p.leak}]")) == expected
