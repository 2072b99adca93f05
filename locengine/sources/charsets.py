"""Which charset bytes without a mark are in: likelihoods of neighbouring bytes.

For every charset a table has the probability of a byte's class after that of the byte before,
in classes of eight byte values. It is counted on samples of Japanese and of western European
text, written in that charset. Of the charsets in which bytes can be read at all, the one that
makes them most likely is taken.
"""

from __future__ import annotations

import functools
import re

import numpy as np

# Samples of running text; only how often signs follow each other matters.
JAPANESE = (
    "このシステムは、文書を読み込んで翻訳します。まず、ファイルの種類を調べてください。\n"
    "データの管理とイベントの設定については、次の表を参照してください。利用者は画面で登録できます。\n"
    "サーバーの起動後、ログを確認し、エラーがあれば担当者に連絡する。処理には時間がかかることがあります。\n"
    "「サービス」の名称、日付、金額、住所を入力し、保存ボタンを押すと、結果が一覧に表示されます。\n"
    "カタカナのコメント、メニュー、メッセージ、ユーザー、パスワード、ネットワーク、プロジェクト。\n"
    "東京の会社では、毎月の報告書を作成し、部長の承認を得てから、全員に配布することになっている。\n"
    "Excelファイル、PDFデータ、Webサイト、idとname、logをcopy、TOPページ、Aセット、iアプリ、vアイ aウb cエd。\n"
    "ファイルname、データbase、ユーザーid、サーバーlog、ドメインcom、メールbox、テストcase、ガギグx ザジズy ダヂヅz。\n"
    "ァィゥェォアイウエオカキクケコガギグゲゴサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\n"
)
ASCII = (
    "The system reads a document, splits it into segments and translates them. See page 12.\n"
    "<p class=\"note\">Open file.txt (version 2.1), then press OK; 3,000 rows were written!</p>\n"
    "for i in range(10): total += prices[i] * 1.19  # sum, name@example.com, https://example.org/a?b=c\n"
    "OPEN THE FILE!! STOP!! READ ALL OF THIS: TERMS AND CONDITIONS APPLY. ERROR!! $$$ *** END --\n"
    "Paris, Berlin and Madrid: where were you? It's a test -- one, two, three.\n"
)
WESTERN = (
    "Élève, où êtes-vous ? Le café est très agréable à côté de l'hôtel ; ça coûte 12 € au maximum.\n"
    "Über die Größe der Straße können wir später sprechen. Schöne Grüße aus München, Köln und Zürich.\n"
    "El niño comió mañana en España. ¿Qué pasó? ¡Adiós, señor! La canción número uno está aquí.\n"
    "Não há informações; a ação começou às três horas. È già così, perché più è meglio. Århus, Ødegård, søndag.\n"
    "“Déjà vu” – voilà l’idée… «Müller & Söhne», garçon, naïve, cœur, œuvre, Þór, ýmsir, ÀÂÄÇÈÊËÎÏÔÖÙÛÜ\n"
)
SAMPLES = {
    "cp932": JAPANESE * 2 + ASCII,
    "euc_jp": JAPANESE * 2 + ASCII,
    "utf-16-le": JAPANESE + ASCII + WESTERN,
    "utf-16-be": JAPANESE + ASCII + WESTERN,
    "cp1252": WESTERN * 2 + ASCII,
}
SHIFT = 3  # classes of 8 byte values
CLASSES = 256 >> SHIFT
# What no text holds: controls, private use, and signs that a wrong reading shows.
_NO_TEXT = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f-\x84\x86-\x9f-￾￿]")


def _pairs(raw: bytes) -> np.ndarray:
    """How often each pair of classes stands in the bytes, at even and at odd places."""
    classes = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) >> SHIFT
    both = classes[:-1] * CLASSES + classes[1:]
    size = CLASSES * CLASSES
    return np.concatenate([np.bincount(both[i::2], minlength=size) for i in (0, 1)])


@functools.cache
def _table(charset: str) -> np.ndarray:
    """Logarithms of the probabilities; places matter only to charsets of two-byte units."""
    counts = _pairs(SAMPLES[charset].encode(charset)).astype(float).reshape(2, CLASSES, CLASSES)
    if not charset.startswith("utf-16"):
        counts[:] = counts.sum(0)
    counts += 0.02
    return np.log(counts / counts.sum(2, keepdims=True)).ravel()


# Signs of Windows-1252 that texts hardly hold, and what texts in units of two
# bytes are made of.
_RARE = re.compile("[ƒˆ‰‹›˜™†‡ŠšŽžŸ¢¤¥¦¨¬¯±²³´µ¶¸¹]")
_USUAL = re.compile("[\t\n\r -~\xa0-ſ‐-⁞₠-₿\u3000-ヿ一-鿿\uff00-\uffef]")
RARE = 6.0  # what each rare sign takes off, in logarithms of probability
WIDE = 14.0  # what units of two bytes, which seldom come without a mark, have to gain


def read(raw: bytes, charset: str) -> str | None:
    """The text, if every byte can be read and no sign is one that texts do not hold."""
    try:
        text = raw.decode(charset)
    except UnicodeDecodeError:
        return None
    if _NO_TEXT.search(text):
        return None
    if charset.startswith("utf-16") and 10 * len(_USUAL.findall(text)) < 9 * len(text):
        return None
    return text


def _likely(pairs: np.ndarray, charset: str) -> float:
    return float(pairs @ _table(charset))


# Pairs with a byte beyond ASCII: the others are the same in all charsets of one-byte units.
_TELLING = np.ones((CLASSES, CLASSES), dtype=np.int64)
_TELLING[: CLASSES // 2, : CLASSES // 2] = 0
_TELLING = np.tile(_TELLING.ravel(), 2)


def _wide(raw: bytes, pairs: np.ndarray, least: float) -> tuple[str, str] | None:
    """Text and charset, if units of two bytes are more likely than `least`."""
    found = None
    for charset in ("utf-16-le", "utf-16-be"):
        score = _likely(pairs, charset) - WIDE
        if score > least and (text := read(raw, charset)) is not None:
            least, found = score, (text, charset)
    return found


def most_likely(raw: bytes) -> tuple[str, str] | None:
    """Text and charset of bytes that are not UTF-8, and have no mark and no escapes."""
    pairs = _pairs(raw)
    scores = []
    for charset in ("cp932", "euc_jp", "cp1252"):
        if (text := read(raw, charset)) is not None:
            rare = RARE * len(_RARE.findall(text)) if charset == "cp1252" else 0
            scores.append((_likely(pairs * _TELLING, charset) - rare, charset, text))
    if not scores and (text := read(raw, "latin-1")) is not None:
        scores.append((0.0, "latin-1", text))
    best = max(scores, default=None)
    least = -np.inf if best is None else _likely(pairs, "cp1252" if best[1] == "latin-1" else best[1])
    return _wide(raw, pairs, least) or (best and (best[2], best[1]))


def wide_units(raw: bytes) -> tuple[str, str] | None:
    """Text and charset of bytes that could be UTF-8 but are more likely units of two bytes."""
    if len(raw) % 2 or not raw:
        return None
    pairs = _pairs(raw)
    return _wide(raw, pairs, _likely(pairs, "cp1252"))
