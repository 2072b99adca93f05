"""Substring dedup: removes every word that a repeated window of words covers.

Words are what ASCII white space leaves, unchanged. Every window of `window` words has a
Rabin-Karp hash. A window is repeated if its words also start anywhere else, in the same
document or another; words covered by a repeated window go, and neighbouring windows merge
into maximal intervals. Windows are judged on the input, not on what is left.

Counting 96 bits for each window of a corpus would shuffle more bytes than the corpus has, so
windows that cannot be repeated are left out first. The least hash of the `GRAM`-word grams
within a window depends on the window's words alone: equal windows have equal least grams.
Runs of windows with the same least gram are one row each; only texts with a run whose gram
stands elsewhere too, or in which a window occurs twice in one batch, are looked at again,
and only the windows of such runs are counted. This is exact: no repeated window is lost,
and what is counted decides.

Keys that stand in a large share of all documents are counted in each batch first; one row
a batch meets the others, the rest are spread by a salt. Texts that occur as a whole in
several rows are found by their keys and count as one text.

Null and empty texts have no words and nothing to remove. Repeated rows are separate
documents, so that a text of at least `window` words in two rows is removed from both. Ids
play no part. Extra columns are kept; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from locengine.config import materialise
from locengine.llm.common import (
    bitmap,
    free_name,
    marked,
    sieve,
    slices,
    text_columns,
    text_keys,
    without,
)
from locengine.llm.words import Words

GRAM = 8
_RUNS = "gram long, t1 long, first int, after int, salt int, twice boolean"
_WINDOWS = "h1 long, h2 int, t1 long, t2 long, start int, salt int, twice boolean"
_SPAN = StructType([StructField("first", LongType()), StructField("after", LongType())])


def _schema(df: DataFrame, ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def least_grams(words: Words, window: int) -> np.ndarray:
    gram = min(GRAM, window)
    grams, _ = words.windows(gram, salt=2)
    return least_of(grams, window - gram + 1)


def _distinct(keys: list[int]) -> np.ndarray:
    return np.unique(np.array(keys, dtype=np.int64), return_index=True)[1]


def _runs(window: int, arrow: pa.Schema):
    """Runs of windows with the same least gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _distinct(batch.column(0).to_pylist())  # a text once a batch
            batch = batch.take(pa.array(own))
            keys = batch.column(0).to_numpy()
            for a, b, texts in slices(batch.column(1)):
                words = Words(texts)
                h, inside = words.windows(window)
                if not inside.any():
                    continue
                least = least_grams(words, window)
                text = np.repeat(np.arange(b - a), np.diff(words.bounds))[: len(h)]
                _, again = marked(np.where(inside, h, np.uint64(0)))
                edge = np.ones(len(h), dtype=bool)
                edge[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                edge[1:] |= inside[1:] != inside[:-1]
                first = np.flatnonzero(edge)
                after = np.append(first[1:], len(h))
                repeats = np.logical_or.reduceat(again, first)
                real = inside[first]
                first, after, repeats = first[real], after[real], repeats[real]
                gram = least[first].view(np.int64)
                salt, twice = marked(gram)
                base = words.bounds[text[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram),
                        pa.array(keys[a:b][text[first]]),
                        pa.array((first - base).astype(np.int32)),
                        pa.array((after - base).astype(np.int32)),
                        pa.array(salt),
                        pa.array(twice | repeats),
                    ],
                    schema=arrow,
                )

    return run


def _windows(window: int, arrow: pa.Schema):
    """Both hashes of the windows of the named runs: t1, t2, raw, firsts, afters come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _distinct([x ^ y for x, y in zip(*(batch.column(i).to_pylist() for i in (0, 1)))])
            batch = batch.take(pa.array(own))
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in slices(batch.column(2)):
                runs = batch.column(3).slice(a, b - a).to_pylist()
                words = Words(texts)
                h1, inside = words.windows(window, salt=1)
                h2, _ = words.windows(window, salt=3)
                size = np.diff(words.bounds)
                text = np.repeat(np.arange(b - a), size)[: len(h1)]
                step = np.zeros(len(h1) + 1, dtype=np.int64)
                for i in range(b - a):
                    bounds = np.array([(r["first"], r["after"]) for r in runs[i]]).T
                    bounds = np.minimum(bounds, size[i]) + words.bounds[i]
                    np.add.at(step, np.minimum(bounds[0], len(h1)), 1)
                    np.add.at(step, np.minimum(bounds[1], len(h1)), -1)
                at = np.flatnonzero((np.cumsum(step)[:-1] > 0) & inside)
                if not len(at):
                    continue
                salt, twice = marked(h1[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[at].view(np.int64)),
                        pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(t1[a:b][text[at]]),
                        pa.array(t2[a:b][text[at]]),
                        pa.array((at - words.bounds[text[at]]).astype(np.int32)),
                        pa.array(salt),
                        pa.array(twice),
                    ],
                    schema=arrow,
                )

    return run


def _elsewhere(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Rows whose key also stands at another place; the salt splits hot keys."""
    place_ = F.xxhash64(*place)
    group = Window.partitionBy(*keys, "salt")
    return (
        rows.withColumn("place", place_)
        .withColumns({"least": F.min("place").over(group), "most": F.max("place").over(group)})
        .where(F.col("twice") | (F.col("least") != F.col("most")))
        .drop("place", "least", "most", "salt", "twice")
    )


def repeated_windows(texts: DataFrame, window: int = 35) -> DataFrame:
    """(t1, t2, starts, copied) of each text with repeated windows, from rows t1, t2, raw.

    starts are the word positions of repeated windows; copied: the whole text stands in
    several rows. Texts without a repeated window have no row.
    """
    schema = _schema(texts, _RUNS)
    runs = texts.select("t1", "raw").mapInArrow(_runs(window, schema), _RUNS)
    again = _elsewhere(runs, ["gram"], ["t1", "first"])
    wanted = materialise(
        again.groupBy("t1").agg(F.collect_list(F.struct("first", "after")).alias("runs")),
        "runs",
    )
    some = sieve(texts.select("t1", "t2", "raw"), "t1", bitmap(wanted, "t1"))
    schema = _schema(texts, _WINDOWS)
    windows = some.join(wanted, "t1").select("t1", "t2", "raw", "runs")
    windows = windows.mapInArrow(_windows(window, schema), _WINDOWS)
    found = _elsewhere(windows, ["h1", "h2"], ["t1", "t2", "start"])
    starts = found.groupBy("t1", "t2").agg(F.collect_list("start").alias("starts"))
    copies = texts.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2")
    none = F.lit(None).cast("array<int>")
    both = starts.select("t1", "t2", "starts", F.lit(False).alias("copied")).unionByName(
        copies.select("t1", "t2", none.alias("starts"), F.lit(True).alias("copied"))
    )
    return both.groupBy("t1", "t2").agg(
        F.first("starts", ignorenulls=True).alias("starts"), F.max("copied").alias("copied")
    )


def covered(n: int, window: int, starts: list[int] | None, copied: bool | None) -> list[tuple]:
    """Maximal intervals of words that repeated windows cover."""
    if copied and n >= window:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts or ())):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """The documents with n_words, n_removed, spans (of removed words) and kept.

    kept are the words left, joined by one space; it is the empty string for a null text.
    Columns of the input with these names are replaced.
    """
    t1, t2, raw = (free_name(docs, x) for x in ("t1", "t2", "raw"))
    k1, k2 = text_keys(text)
    names = ["n_words", "n_removed", "spans", "kept"]
    keyed = docs.withColumns({t1: k1, t2: k2})
    texts = keyed.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(t1).alias("t1"),
        F.col(t2).alias("t2"),
        F.col(f"`{text}`").cast("binary").alias("raw"),
    )
    found = materialise(repeated_windows(texts, window), "repeats")
    starts, copied = (free_name(keyed, x) for x in ("starts", "copied"))
    found = found.select(
        F.col("t1").alias(t1),
        F.col("t2").alias(t2),
        F.col("starts").alias(starts),
        F.col("copied").alias(copied),
    )
    bits = bitmap(found, t1)

    def compute(raws, *more):
        out: list[list] = [[], [], [], []]
        for i, r in enumerate(raws):
            words = r.split() if r else []
            spans = covered(len(words), window, more[0][i], more[1][i]) if more else []
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept = kept + words[at:] if spans else words
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append([{"first": a, "after": b} for a, b in spans])
            out[3].append(b" ".join(kept).decode("utf-8", "replace"))
        return out

    fields = [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("spans", ArrayType(_SPAN)),
        StructField("kept", StringType()),
    ]
    hit = sieve(keyed, t1, bits).join(found, [t1, t2], "left")
    changed = text_columns(hit, text, fields, compute, extra=(starts, copied))
    same = text_columns(sieve(keyed, t1, bits, hit=False), text, fields, compute)
    return without(changed.unionByName(same), [t1, t2]).select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names), *names
    )
