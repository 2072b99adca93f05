"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of digits, ASCII letters and characters beyond ASCII, with A-Z in lower
case. A window is `window` consecutive words of a benchmark item, or the whole item if it
has fewer. The alphabet of the search is the word: a shift table over blocks of two words
skips positions at which no window can end, buckets by the last block and then the first
one select the windows to test, and the words themselves are compared.

Null and empty texts have no words: as documents they are clean, as items they have no
windows. Items without an id are left out; rows of the same id count as one item, and
repeated documents are judged one by one. Empty tables give empty results or clean documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from locengine.config import materialise
from locengine.llm.common import free_name, text_columns

_WORD = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)
_SPAN = StructType([StructField("first", LongType()), StructField("after", LongType())])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class Search:
    """Windows of one length, each with the ids of its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = {}
        for window, ids in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                skip = length - end
                if skip < self.shift.get(block, length):
                    self.shift[block] = skip
            firsts = self.buckets.setdefault(window[length - self.block :], {})
            firsts.setdefault(window[: self.block], []).append((list(window), ids))

    def find(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """Start of each occurrence, ascending, with the ids."""
        length, size, far = self.length, self.block, self.length - self.block + 1
        skip_of, n, at = self.shift.get, len(words), self.length
        while at <= n:
            block = tuple(words[at - size : at])
            skip = skip_of(block, far)
            if skip:
                at += skip
                continue
            start = at - length
            for window, ids in self.buckets[block].get(tuple(words[start : start + size]), ()):
                if words[start:at] == window:
                    yield start, ids
            at += 1


def searches(items: Iterable[tuple[str, bytes | None]], window: int) -> list[Search]:
    """One search for each length of window that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            windows = by_length.setdefault(length, {})
            windows.setdefault(tuple(words[i : i + length]), set()).add(item)
    return [Search(windows, length) for length, windows in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, after in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _scan(docs: DataFrame, text: str, tables: list[Search], spans: str, items: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    again = spans in docs.columns

    def compute(texts, *before):
        counts, found, ids = [], [], []
        for i, raw in enumerate(texts):
            words = words_of(raw)
            at, names = [], set()
            for search in shared.value:
                for start, of in search.find(words):
                    at.append((start, start + search.length))
                    names |= of
            if before:
                at += [(s["first"], s["after"]) for s in before[0][i]]
                names.update(before[1][i])
            counts.append(len(words))
            found.append([{"first": a, "after": b} for a, b in merged(at)])
            ids.append(sorted(names))
        return [counts, found, ids]

    return text_columns(
        docs,
        text,
        [
            StructField("n_words", LongType()),
            StructField(spans, ArrayType(_SPAN)),
            StructField(items, ArrayType(StringType())),
        ],
        compute,
        extra=(spans, items) if again else (),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    per: int = 20,
    block_bytes: int = 1 << 24,
) -> DataFrame:
    """The documents with n_words, hits (spans of words), items, n_hit, n_items, contaminated.

    contaminated: at least one word, and at least one in `per` of all words, is hit. Columns of
    the input with these names are replaced.

    The benchmark is sent to the tasks in blocks of about `block_bytes` (a longer item
    alone); with more than one, each block is searched in all documents in turn and the
    findings are merged in the document's row, so nothing is shuffled.
    """
    items = benchmark.select(
        F.col(f"`{item_id}`").cast("string").alias("id"),
        F.col(f"`{item_text}`").cast("binary").alias("raw"),
    ).where("id is not null and raw is not null")
    size = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    spans, found = free_name(docs, "hits_of_items"), free_name(docs, "found_items")
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)) == b)
        tables = searches(((r.id, bytes(r.raw)) for r in own.toLocalIterator()), window)
        docs = _scan(docs, text, tables, spans, found)
        if blocks > 1:
            docs = materialise(docs, "decontaminate")
    hit = F.aggregate(
        F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"]
    )
    out = {"hits": F.col(spans), "items": F.col(found), "n_hit": hit}
    out["n_items"] = F.size(found).cast("long")
    made = docs.withColumns(out).drop(spans, found)
    judged = (F.col("n_hit") > 0) & (F.lit(per) * F.col("n_hit") >= F.col("n_words"))
    return made.withColumn("contaminated", judged.cast(BooleanType()))
