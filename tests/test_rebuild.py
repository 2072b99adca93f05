import random
import time

from pyspark.sql import functions as F

from locengine.operators.extract import extract_text
from locengine.operators.memory import build_translation_map
from locengine.operators import phrases
from locengine.operators.phrases import apply_translation_map
from locengine.operators.rebuild import LINES, rebuild_documents, rewrite_lines

DOC = "doc_id string, text string"
SEGMENT = (
    "doc_id string, seq long, line_idx int, type string, cell_index int, text string, "
    "translated_text string"
)


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOC)


def rebuilt(spark, text, segments):
    rows = [("0", i, *s) for i, s in enumerate(segments)]
    out = rebuild_documents(docs(spark, text), spark.createDataFrame(rows, SEGMENT))
    return out.head().text


def test_identity(spark):
    """Segments translated by themselves give back every document."""
    rng = random.Random(3)
    lines = ["", "## 題", "- 項目", "| 名 | x | 値 |", "```", "│ 図 │ 表 │", "文章", "  文", "plain"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 30))) for _ in range(40)]
    texts += [t + "\n" for t in texts[:10]] + ["", "\n"]
    df = docs(spark, *texts)
    same = extract_text(df).withColumn("translated_text", F.col("text"))
    out = {r.doc_id: r.text for r in rebuild_documents(df, same).collect()}
    assert [out[str(i)] for i in range(len(texts))] == texts


def test_lines_and_cells(spark):
    text = "## タイトル\n- 項目一\nkeep\n| 管理 | イベント管理 |\n最後\n"
    out = rebuilt(
        spark,
        text,
        [
            (0, "body", None, "## タイトル", "## Tiêu đề"),
            (1, "body", None, "- 項目一", "Mục một"),
            (3, "table_cell", 0, "管理", "quản lý"),
            (3, "table_cell", 1, "イベント管理", "quản lý sự kiện"),
            (4, "body", None, "最後", None),
        ],
    )
    assert out == "## Tiêu đề\n- Mục một\nkeep\n| quản lý | quản lý sự kiện |\n最後\n"


def test_cells_win_over_body_and_the_last_body_wins(spark):
    out = rebuilt(
        spark,
        "| 名 |\n文",
        [
            (0, "body", None, "| 名 |", "B"),
            (0, "table_cell", 0, "名", "C"),
            (1, "body", None, "文", "first"),
            (1, "body", None, "文", "last"),
            (9, "body", None, "文", "beyond the end"),
        ],
    )
    assert out == "| C |\nlast"


def diagram(spark, line, *pairs):
    rows = [("0", i, 0, "diagram_token", None, a, b) for i, (a, b) in enumerate(pairs)]
    out = rewrite_lines(docs(spark, line), spark.createDataFrame(rows, SEGMENT)).head()
    return out.line, out.overflow


def test_diagram_tokens(spark):
    # The widths of the token and of the spaces after it are kept.
    assert diagram(
        spark, "│ サービス   │ ナレッジ   │", ("サービス", "Dịch vụ"), ("ナレッジ", "Kiến thức")
    ) == ("│ Dịch vụ    │ Kiến thức  │", False)
    assert diagram(spark, "│ ポータル   │", ("ポータル", "Cổng thông tin")) == (
        "│ Cổng thông tin│", True,
    )
    # All occurrences; the first entry of a repeated token is used.
    assert diagram(spark, "│表 │表 │", ("表", "b"), ("表", "x")) == ("│b  │b  │", False)


def test_longer_token_and_its_part(spark):
    # The part also occurs in the longer token; replacements go from right to left.
    assert diagram(spark, "管理 イベント管理 ", ("管理", "ql"), ("イベント管理", "qlsk"))[0] == (
        "ql   qlsk" + " " * 11
    )


def brute_force(text, pairs):
    ordered = sorted(pairs, key=lambda p: -len(p[0]))
    out = text
    for source, target in ordered:
        out = out.replace(source, target)
    return None if out == text else out


def test_phrases(spark):
    schema = "doc_id string, seq long, text string"
    texts = spark.createDataFrame(
        [
            ("d", 0, "Test 日本語 here"), ("d", 1, " 文[1] "), ("d", 2, "イベント管理と管理"),
            ("d", 3, "none"), ("d", 4, "  "), ("d", 5, "[2]"), ("e", 6, "日本語"), ("d", 7, "日本語"),
        ],
        schema,
    )
    tmap = spark.createDataFrame(
        [("d", "日本語", "Tiếng Nhật", 0), ("d", "文", "câu", 1), ("d", "管理", "Q", 2),
         ("d", "イベント管理", "E", 3)],
        "doc_id string, source string, target string, seq long",
    )
    out = apply_translation_map(texts, tmap).orderBy("seq").collect()
    assert [(r.translated_text, r.match_kind) for r in out] == [
        ("Test Tiếng Nhật here", "phrase"), ("câu", "plain"), ("EとQ", "phrase"), (None, None),
        (None, None), (None, None), (None, None), ("Tiếng Nhật", "exact"),
    ]


def test_phrases_equal_brute_force(spark):
    """Replacements that create, destroy and overlap later phrases."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc", k=n))
    pairs = {}
    for doc in range(12):
        for _ in range(25):
            pairs.setdefault(doc, {}).setdefault(word(rng.randint(1, 4)), word(rng.randint(1, 5)))
    rows = [(d, s, t, i) for d, m in pairs.items() for i, (s, t) in enumerate(m.items())]
    texts = [(d, i, word(30)) for d in range(12) for i in range(40)]
    out = apply_translation_map(
        spark.createDataFrame(texts, "doc_id long, seq long, text string"),
        spark.createDataFrame(rows, "doc_id long, source string, target string, seq long"),
    ).collect()
    got = {(r.doc_id, r.seq): r.translated_text for r in out}
    assert len(out) == len(texts)
    for d, i, text in texts:
        assert got[(d, i)] == brute_force(text, list(pairs[d].items()))


def test_ties_follow_the_first_place(spark):
    """Of phrases of equal length the one that came first in the document is replaced first,
    also where its last translation came later."""
    pairs = [("d", 0, "ab", "1"), ("d", 1, "bc", "2"), ("d", 2, "ab", "3")]
    segments = spark.createDataFrame(pairs, "doc_id string, seq long, text string, translated_text string")
    tmap = build_translation_map(segments)
    assert {(r.source, r.target, r.seq, r.first_seq) for r in tmap.collect()} == {
        ("ab", "3", 2, 0), ("bc", "2", 1, 1),
    }
    texts = spark.createDataFrame([("d", 9, "abc")], "doc_id string, seq long, text string")
    assert apply_translation_map(texts, tmap).head().translated_text == "3c"


def test_phrases_that_only_replacements_make(spark):
    """A chain of phrases of which only the first stands in any text, in a run of its own; long
    phrases over the edges of replacements; a null document."""
    texts = [("d", 5, "see abcd here"), ("d", 5000, "pq"), (None, 0, "abcd"), ("e", 0, "xx")]
    pairs = [("d", "abcd", "klm", 0), ("d", "klm", "no", 1), ("d", "o ", "p", 2), ("d", "ee n", "!", 3),
             (None, "abcd", "null", 0), ("d", "p", "q", 9)]
    out = apply_translation_map(
        spark.createDataFrame(texts, "doc_id string, seq long, text string"),
        spark.createDataFrame(pairs, "doc_id string, source string, target string, seq long"),
    ).collect()
    got = {(r.doc_id, r.seq): r.translated_text for r in out}
    assert got == {
        ("d", 5): brute_force("see abcd here", [p[1:3] for p in pairs if p[0] == "d"]),
        ("d", 5000): "qq", (None, 0): "null", ("e", 0): None,
    }
    none = spark.createDataFrame([], "doc_id string, source string, target string, seq long")
    left = apply_translation_map(spark.createDataFrame(texts, "doc_id string, seq long, text string"), none)
    assert [r.translated_text for r in left.collect()] == [None] * 4


def test_documents_of_few_phrases_send_no_windows(spark, monkeypatch):
    """Nothing is looked up by windows where every document has few phrases; the results are
    those of the lookup, of which documents of many phrases have need."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abc", k=n))
    pairs = [(d if d else None, word(1 + i % 4), word(2), i) for d in range(6) for i in range(20 * d + 5)]
    texts = [(d if d else None, i * 100, word(20)) for d in range(6) for i in range(12)]
    tmap = spark.createDataFrame(pairs, "doc_id long, source string, target string, seq long").dropDuplicates(
        ["doc_id", "source"]
    ).localCheckpoint()
    rows = spark.createDataFrame(texts, "doc_id long, seq long, text string")
    found = []
    for few in (0, 15, 1024):
        monkeypatch.setattr(phrases, "FEW", few)
        if few == 1024:
            monkeypatch.setattr(phrases, "_probes", None)
        out = apply_translation_map(rows, tmap).collect()
        found.append(sorted(map(str, out)))
    assert len(found[0]) == len(texts) and found[0] == found[1] == found[2]


def test_very_long_texts_and_phrases(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choices("ab ", k=5000))
    pairs = {long[1000:1900]: "X", long[2000:2003]: "yy", long[10:12]: "b", "zzz": long[:50]}
    text = long + "zzz" + long[900:2100]
    out = apply_translation_map(
        spark.createDataFrame([(1, 0, text)], "doc_id long, seq long, text string"),
        spark.createDataFrame([(1, s, t, i) for i, (s, t) in enumerate(pairs.items())],
                              "doc_id long, source string, target string, seq long"),
    )
    assert out.head().translated_text == brute_force(text.strip(), list(pairs.items()))


def test_a_hot_document_takes_time_by_its_texts(spark):
    """Twice the texts, with as many phrases as texts: about twice the work, not four times."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    lines = [" ".join(word() for _ in range(8)) for _ in range(16_000)]
    seconds = []
    for n in (200, 8_000, 16_000):
        texts = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines[:n])], "doc_id long, seq long, text string")
        pairs = [(1, t[:13] if i % 2 else t[7:11], "x", i) for i, t in enumerate(lines[:n])]
        tmap = spark.createDataFrame(pairs, "doc_id long, source string, target string, seq long")
        started = time.perf_counter()
        rows = apply_translation_map(texts, tmap.dropDuplicates(["source"])).filter("translated_text LIKE '%x%'")
        assert rows.count() == n
        seconds.append(time.perf_counter() - started)
    assert seconds[2] < 2 * seconds[1] + 2


def test_edits_of_many_ranges(spark):
    """A document of many ranges equals its lines replaced one by one, whatever the line ends."""
    n = 2 * LINES + 7
    lines = [f"文{i}" if i % 3 else f"| 名{i} | x |" for i in range(n)]
    texts = {"0": "\n".join(lines) + "\n", "1": "文", "2": "", "3": "\r\n".join(lines[:LINES]), "4": None}
    schema = "doc_id string, file_type string, text string"
    docs = spark.createDataFrame([(k, f"t{k}", t) for k, t in texts.items()] + [(None, "n", "文")], schema)
    rows = [("0", i, i, "body", None, f"文{i}", f"v{i}") for i in range(n) if i % 3 and i % 5 == 0]
    rows += [("0", i, i, "table_cell", 0, f"名{i}", f"c{i}") for i in range(n) if i % 30 == 0]
    rows += [("0", n + 9, n + 9, "body", None, "x", "beyond"), ("1", 0, 0, "body", None, "文", "v")]
    out = rebuild_documents(docs, spark.createDataFrame(rows, SEGMENT))
    assert out.columns == ["doc_id", "file_type", "text"]
    got = {r.doc_id: (r.file_type, r.text) for r in out.collect()}
    want = [
        (f"| c{i} | x |" if i % 30 == 0 else t) if i % 3 == 0 else (f"v{i}" if i % 5 == 0 else t)
        for i, t in enumerate(lines)
    ]
    assert got["0"] == ("t0", "\n".join(want) + "\n")
    assert got["3"] == ("t3", "\n".join(lines[:LINES]))
    assert (got["1"], got["2"], got["4"], got[None]) == (("t1", "v"), ("t2", ""), ("t4", None), ("n", "文"))
    edits = rewrite_lines(docs, spark.createDataFrame(rows, SEGMENT)).collect()
    assert len(edits) == len(rows) - 1 and all(r.line != r.raw for r in edits)
