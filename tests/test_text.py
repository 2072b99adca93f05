import unicodedata

import pytest
from pyspark.sql import functions as F

from locengine.functions import markup, text as t



@pytest.mark.parametrize(
    "value, script, translatable",
    [
        ("テスト", True, True),
        ("Hello テスト world", True, True),
        ("Hello world", False, False),
        ("", False, False),
        (None, False, False),
        ("   ", False, False),
        ("　", False, False),
        ("https://example.com/テスト", True, False),
        ("test@example.com", False, False),
        ("user@例え.jp", True, False),
        ("=SUM(A1:A10)", False, False),
        ("=合計(A1)", True, False),
        ("99.9%", False, False),
        ("１２３", True, False),
        ("・ー〇", False, False),
        ("Ａ", True, True),
        ("ｶﾅ", True, True),
        ("※ done", False, False),
    ],
)
def test_script_and_translatable(apply, value, script, translatable):
    assert apply([value], t.has_script(F.col("text"))) == [script]
    assert apply([value], t.is_translatable(F.col("text"))) == [translatable]


def test_leak_differs_from_script(apply):
    values = ["・", "ー", "Ａ１", "㐀", "作成", "Người tạo", None]
    assert apply(values, t.has_leak(F.col("text"))) == [False, True, False, True, True, False, False]


def test_strip_removes_all_unicode_space(apply):
    values = ["　a　", "\t\n a b \r\n", " a ", "a", "", "\x85a "]
    assert apply(values, t.strip_ws(F.col("text"))) == [v.strip() for v in values]


def test_lines(apply):
    values = ["a\nb", "a\nb\n", "a\r\nb\rc", "", "\n", "\n\n", "a\n\nb"]
    expected = [["a", "b"], ["a", "b"], ["a", "b", "c"], [], [""], ["", ""], ["a", "", "b"]]
    assert apply(values, t.line_array(F.col("text"))) == expected


def test_chunks(apply):
    assert apply(["あ" * 100], t.chunk_text(F.col("text"), 30)) == [["あ" * 30] * 3 + ["あ" * 10]]
    assert apply(["文A。文B。文C。文D。"], t.chunk_text(F.col("text"), 8)) == [["文A。文B。", "文C。文D。"]]
    assert apply([None, "", "短い"], t.chunk_text(F.col("text"), 8)) == [[], [], ["短い"]]
    # A newline is a boundary as well, and the last boundary of the window counts.
    assert apply(["あ\nい。うえお"], t.chunk_text(F.col("text"), 5)) == [["あ\nい。", "うえお"]]
    # Within the limit nothing is cut.
    assert apply(["あ。い"], t.chunk_text(F.col("text"), 3)) == [["あ。い"]]


def test_chunks_are_lossless(apply):
    values = ["".join("あい。！\n x"[(i * 7 + j) % 7] for j in range(200 + i)) for i in range(40)]
    for chunks, value in zip(apply(values, t.chunk_text(F.col("text"), 17)), values):
        assert "".join(chunks) == value
        assert all(0 < len(c) <= 17 for c in chunks)


def test_sentence_pieces(apply):
    long = "あ" * 6 + "。"
    assert apply(["あ。い。う。"], t.sentence_pieces(F.col("text"), 4)) == [["あ。い。", "う。"]]
    # An over-long sentence stays whole; whitespace after an end is dropped.
    assert apply([long + " い。う"], t.sentence_pieces(F.col("text"), 4)) == [[long, "い。う"]]
    assert apply(["あいう"], t.sentence_pieces(F.col("text"), 4)) == [["あいう"]]
    assert apply(["あいうえおか"], t.sentence_pieces(F.col("text"), 4)) == [["あいうえおか"]]
    assert apply(["あ。。！い"], t.sentence_pieces(F.col("text"), 3)) == [["あ。。", "！い"]]


def test_widths(apply):
    values = ["abc", "サービス", "│ポータル│", "", "é", "ａｂ", "a\tb", "が゙"]
    assert apply(values, t.visual_width(F.col("text"))) == [3, 8, 10, 0, 1, 4, 2, 2]


def test_width_counts_every_wide_character(apply):
    sample = [chr(c) for c in range(0x2E80, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    hidden = ("Mn", "Me", "Mc", "Cf", "Cn")
    sample = [c for c in sample if unicodedata.category(c) not in hidden]
    # Jamo that join the letter before them take no room.
    sample = [c for c in sample if not 0xD7B0 <= ord(c) <= 0xD7FF]
    expected = [2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in sample]
    assert apply(sample, t.visual_width(F.col("text"))) == expected


def test_truncate(apply):
    values = ["サービス", "abcdefgh", "aサービス", "éééééé", ""]
    assert apply(values, t.truncate_width(F.col("text"), 5)) == [
        "サー", "abcde", "aサー", "é" * 5, "",
    ]


def test_spacing(apply):
    values = {
        "nghiệpA": "nghiệp A",
        "phần2": "phần 2",
        "RAGTrò": "RAG Trò",
        "SaaSNền": "SaaS Nền",
        "SaaS OAuth2": "SaaS OAuth2",
        "abcĐạt": "abc Đạt",
        "Việt Nam": "Việt Nam",
        "": "",
        "abcDef": "abcDef",
    }
    assert apply(list(values), t.fix_spacing(F.col("text"))) == list(values.values())


def test_line_prefixes(apply):
    pairs = [
        ("## タイトル", "Tiêu đề", "## Tiêu đề"),
        ("## タイトル", "## Tiêu đề", "## Tiêu đề"),
        ("- 項目一", "Mục một", "- Mục một"),
        ("    - 項目", "- Mục", "    - Mục"),
        ("見出し", "|### 2.3 Heading", "2.3 Heading"),
        ("見出し", "Danh mục |", "Danh mục"),
        ("見出し", "# ## A", "A"),
        ("- 項目", "- - - A", "- A"),
        ("　見出し", "A", " A"),
    ]
    out = apply(
        [(a, b) for a, b, _ in pairs],
        t.rebuild_line(F.col("raw"), F.col("done")),
        "raw string, done string",
    )
    assert out == [c for _, _, c in pairs]


def test_locations(apply):
    values = ["line[3]", "word/document.xml:p[4][p1]", "xl/workbook.xml:sheet[0]", "x", "a:si[2]"]
    assert [tuple(r) for r in apply(values, t.parse_location(F.col("text")))] == [
        (None, "line", 3, None),
        ("word/document.xml", "p", 4, 1),
        ("xl/workbook.xml", "sheet", 0, None),
        (None, None, None, None),
        ("a", "si", 2, None),
    ]


def test_tag_checks(apply):
    pairs = [
        ("<tag1>a</tag1>", "<tag1>b</tag1>"),
        ("<tag1>a</tag1>", "b"),
        ("<tag1>a</tag1><tag2/>", "<tag1>b</tag1>"),
        ("a", None),
    ]
    columns = "s string, t string"
    match = t.tags_match(F.col("s"), F.col("t"))
    every = t.tags_match(F.col("s"), F.col("t"), True)
    assert apply(pairs, match, columns) == [True, False, True, False]
    assert apply(pairs, every, columns) == [True, False, False, False]


def test_exchange_tags_round_trip(apply):
    values = [
        "text<tag1>bold</tag1>more<tag2/>break",
        "plain & <b>",
        "<tag1>a<tag2>b</tag2></tag1>",
        "<tag12>x\ny</tag12>",
    ]
    for version in markup.VERSIONS:
        there = markup.text_to_xliff(F.col("text"), version)
        back = markup.xliff_to_tags(F.concat(there, F.lit("")), version)
        assert apply(values, back) == values
    assert apply(values[:1], markup.tags_to_xliff(F.col("text"), "2.1")) == [
        'text<pc id="1" type="fmt">bold</pc>more<ph id="2" type="other"/>break'
    ]
    assert apply(values[:1], markup.tags_to_xliff(F.col("text"), "1.2")) == [
        'text<bpt id="1" ctype="x-tag1">&lt;tag1&gt;</bpt>bold<ept id="1">&lt;/tag1&gt;</ept>'
        'more<x id="2" ctype="x-tag2"/>break'
    ]


def test_state_maps(apply):
    to = ["new", "needs-translation", "translated", "needs-review-translation", "signed-off", "x"]
    assert apply(to, markup.map_state(F.col("text"), "2.1")) == [
        "initial", "initial", "translated", "reviewed", "final", "initial",
    ]
    back = ["initial", "translated", "reviewed", "final", "x"]
    assert apply(back, markup.map_state(F.col("text"), "1.2")) == [
        "new", "translated", "needs-review-translation", "final", "new",
    ]
