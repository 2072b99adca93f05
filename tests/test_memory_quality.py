import pytest

from locengine.operators import memory, quality

MEMORY = "source string, target string, seq long"


@pytest.fixture()
def tm(spark):
    return spark.createDataFrame([("文", "A", 1), ("空", "", 1), ("無", None, 1)], MEMORY)


def test_lookup(spark, tm):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["文", "空", "無", "他", "文"])], "seq long, text string")
    out = memory.lookup_memory(df, tm).orderBy("seq").collect()
    assert [(r.translated_text, r.cache_hit) for r in out] == [
        ("A", True), (None, False), (None, False), (None, False), ("A", True),
    ]
    misses = memory.memory_misses(df.union(df), tm).collect()
    assert sorted(r.text for r in misses) == ["他", "無", "空"]


def test_upsert_and_versions(spark, tm, tmp_path):
    new = spark.createDataFrame([("文", "B", 2), ("新", "N", 2), ("文", "C", 3)], MEMORY)
    out = memory.upsert_memory(tm, new)
    assert {(r.source, r.target) for r in out.collect()} == {
        ("文", "C"), ("空", ""), ("無", None), ("新", "N"),
    }
    path = memory.write_memory(out, str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        memory.write_memory(out, str(tmp_path), 1)


def test_translation_map(spark):
    rows = [
        ("d", 0, " 文 ", "A"), ("d", 1, "文", " B "), ("d", 2, "同", "同"), ("d", 3, "空", " "),
        ("d", 4, "", "x"), ("e", 0, "文", "E"), ("d", 5, "無", None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, seq long, text string, translated_text string")
    out = memory.build_translation_map(df).collect()
    assert {(r.doc_id, r.source, r.target) for r in out} == {("d", "文", "B"), ("e", "文", "E")}


def test_merge(spark):
    segments = spark.createDataFrame(
        [(0, "文 ", "old"), (1, "他", "keep"), (2, "文", None), (3, "空", "keep")],
        "seq long, text string, translated_text string",
    )
    reviewed = spark.createDataFrame(
        [(0, "文", "first"), (1, " 文", " last "), (2, "空", " "), (3, "", "x")],
        "seq long, text string, translated_text string",
    )
    out = memory.merge_reviewed(segments, reviewed).orderBy("seq").collect()
    assert [(r.translated_text, r.reviewed) for r in out] == [
        ("last", True), ("keep", False), ("last", True), ("keep", False),
    ]


SCORED = "i int, text string, translated_text string, retry_count int, cache_hit boolean"


def classified(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCORED)
    return quality.classify(df)


def test_scores(spark):
    rows = [
        (("作成者", "Người tạo", 0, False), 1.0, "high"),
        (("作成者", "Người 作成 tạo", 0, False), 0.2, "low"),
        (("text<tag1>bold</tag1>more", "text bold more", 0, False), 0.6, "medium"),
        (("text<tag1>bold</tag1>more", "văn bản<tag1>đậm</tag1>thêm", 0, False), 1.0, "high"),
        (("これは非常に長いテキストです。翻訳してください。", "OK", 0, False), 0.7, "medium"),
        (("テスト", "A" * 100, 0, False), 0.7, "medium"),
        (("テスト", "Kiểm tra", 0, True), 1.0, "high"),
        (("テスト", "Kiểm tra", 2, False), 0.8, "medium"),
        (("テスト", "Kiểm tra", 9, False), 0.7, "medium"),
        (("テスト", "Kiểm tra", 1, False), 0.9, "high"),
        (("テスト", "", 0, False), 0.0, "low"),
        (("テスト", None, 0, True), 0.0, "low"),
        (("テスト", "　 ", 0, False), 0.0, "low"),
        # Kept marks are no leftover script.
        (("・テスト", "・Kiểm tra", 0, False), 1.0, "high"),
        # 1.0 - 0.5 - 0.4 - 0.3 + 0.2 is zero before the floor.
        (("<tag1>長い文章長い文章長い文章</tag1>", "長", 0, True), 0.0, "low"),
    ]
    out = classified(spark, [r for r, _, _ in rows]).orderBy("i").collect()
    assert [(r.confidence, r.bucket) for r in out] == [(c, b) for _, c, b in rows]


def test_stats(spark):
    df = classified(
        spark,
        [
            ("テスト", "Kiểm tra", 0, False),
            ("テスト", "Kiểm tra", 2, False),
            ("テスト", "", 0, False),
            ("テスト", "Kiểm 作 tra", 0, False),
        ],
    )
    row = quality.confidence_stats(df).head()
    assert (row.total, row.high_count, row.medium_count, row.low_count) == (4, 1, 1, 2)
    assert row.high_pct == 25.0 and row.avg_confidence == pytest.approx((1 + 0.8 + 0.2) / 4)
    empty = quality.confidence_stats(df.filter("false")).head()
    assert tuple(empty) == (0, 0, 0, 0, 0.0, 0.0)
