"""Replacement of known texts and phrases by the translation map of their document.

A phrase is indexed by its head: its first 1, 2, 4, ... or 64 characters, as many as it has. The
windows of a text of the same lengths meet the heads of their document in an equi join on a
hash, so a text is paired only with phrases that begin in it alike, however many its document
has. A head is 64 characters or at least half its phrase, so hardly any other shares it.

A document of few phrases (``FEW``) brings all of them to each of its runs: a run of texts is then
met by a bounded number of phrases, and no window has to be sent.

Texts are worked on in runs of a document. Phrases are replaced one after the other, longest
first, and a replacement can make others occur that no text of the run held before. `missing`
reports windows around replacements that may be such heads; those that are bring their
phrases, and their runs are worked on again, until no run needs another phrase.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from locengine.config import materialise
from locengine.functions.text import TAG, strip_tags, strip_ws
from locengine.operators.ordering import bucket_of
from locengine.operators.runs import FOOTNOTE_ANY

HEADS = (1, 2, 4, 8, 16, 32, 64)
TEXTS_PER_RUN = 256
RUNS_AT_A_TIME = 64
FEW = 1024  # phrases of a document that go to all its runs
PIECE = 1 << 20  # characters that are hashed at a time
BITS = 1 << 24  # 2 MB; it spares rows without a partner, the join decides
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def head_length(n: Column) -> Column:
    """Greatest of the lengths of heads that is at most n."""
    found = F.lit(HEADS[0])
    for size in HEADS[1:]:
        found = F.when(n >= size, F.lit(size)).otherwise(found)
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(base: int, bits: int) -> np.ndarray:
    made = np.full(1 << bits, base, dtype=np.uint64)
    made[0] = 1
    return np.multiply.accumulate(made)


def _hashed(parts: list[tuple[int, int, str]], groups: np.ndarray, sizes: list[int], keep):
    codes = np.frombuffer("".join(p for *_, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    up, down = (_powers(b, n.bit_length()) for b in (_BASE, _UNBASE))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    lengths = np.array([len(p) for *_, p in parts])
    owner = np.repeat(np.arange(len(parts)), lengths)
    text = np.array([i for i, *_ in parts])
    shift = np.array([at for _, at, _ in parts]) - (np.cumsum(lengths) - lengths)
    for size in sizes:
        if n < size:
            continue
        own = owner[: n - size + 1]
        h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        h = _mixed(h ^ _mixed(groups + np.uint64(size))[text[own]]).view(np.int64)
        at = np.flatnonzero((own == owner[size - 1 :]) & keep(h))
        yield h[at], text[own[at]], at + shift[own[at]]


def windows(texts: list[str], groups: list[int], sizes: list[int], keep):
    """Hash, text and first place of the windows of some sizes whose hash `keep` takes.

    Arrays of limited size: long texts are cut into pieces that overlap by a window.
    """
    own = np.array([g & (1 << 64) - 1 for g in groups], dtype=np.uint64)
    parts, total = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            parts.append((i, at, text[at : at + PIECE + sizes[-1] - 1]))
            total += len(parts[-1][2])
            if total >= PIECE:
                yield from _hashed(parts, own, sizes, keep)
                parts, total = [], 0
    if parts:
        yield from _hashed(parts, own, sizes, keep)


def _may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & (BITS - 1)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _any(keys: np.ndarray) -> np.ndarray:
    return np.ones(len(keys), dtype=bool)


def _index(tmap: DataFrame, keys: list[str]) -> DataFrame:
    """The map's rows with the hash of their head, `_key`, and their place among equals."""
    first = F.col("first_seq") if "first_seq" in tmap.columns else F.col("seq")
    found = tmap.filter("source <> ''").select(
        F.xxhash64(*keys).alias("_group"),
        "source",
        "target",
        first.cast("bigint").alias("_first"),
        head_length(F.length("source")).alias("_size"),
    )
    schema = "_group long, source string, target string, _first long, _size int, _key long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, sources, *_, sizes = (c.to_pylist() for c in batch.columns)
            made = np.zeros(len(sizes), dtype=np.int64)
            for size in set(sizes):
                own = [i for i, n in enumerate(sizes) if n == size]
                heads = [sources[i][:size] for i in own]
                for keys, text, _ in windows(heads, [groups[i] for i in own], [size], _any):
                    made[np.array(own)[text]] = keys
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made)], [*batch.schema.names, "_key"]
            )

    return found.mapInArrow(hashed, schema)


def _bits_of(index: DataFrame) -> np.ndarray:
    slot = F.pmod(F.col("_key"), F.lit(BITS))
    rows = (
        index.select((slot / 64).cast("long").alias("word"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(BITS // 64, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words


def _probes(texts: DataFrame, keys: list[str], sizes: list[int], bits) -> DataFrame:
    """(keys, _run, _key): windows of a run's texts that may be heads."""
    names = [*keys, "_run", "_key"]
    schema = T.StructType(
        [*(texts.schema[c] for c in [*keys, "_run"]), T.StructField("_key", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(len(keys) + 1).to_pylist()
            forms = batch.column(len(keys) + 2).to_pylist()
            owner = [i for i, own in enumerate(forms) for _ in own]
            texts_, of = [t for own in forms for t in own], [groups[i] for i in owner]
            # Texts of a run mostly stand together; each of its windows is sent once from here.
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys) + 1)), strict=True))
            first: dict[tuple, int] = {}
            run_of = np.array([first.setdefault(ids[i], i) for i in owner], dtype=np.int64)
            for made, text, _ in windows(texts_, of, sizes, lambda h: _may_be(bits.value, h)):
                at = run_of[text]
                order = np.lexsort((made, at))
                made, at = made[order], at[order]
                new = np.ones(len(made), dtype=bool)
                new[1:] = (made[1:] != made[:-1]) | (at[1:] != at[:-1])
                own = [batch.column(k).take(pa.array(at[new])) for k in range(len(keys) + 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(made[new])], names)

    forms = F.array_distinct(
        F.filter(F.array("_text", "_plain", "_bare", "_bare_plain"), lambda c: c.isNotNull())
    )
    return texts.select(
        *keys, "_run", F.xxhash64(*keys).alias("_group"), forms.alias("_forms")
    ).mapInArrow(run, schema).distinct()


class Phrases:
    """The phrases that a run's texts may hold: found by head, replaced in order."""

    def __init__(self, entries: list[dict], sizes: list[int], group: int, has_all: bool):
        ordered = sorted(entries, key=lambda e: (-len(e["source"]), e["_first"], e["source"]))
        self.pairs = [(e["source"], e["target"]) for e in ordered]
        self.whole = dict(self.pairs)
        self.sizes, self.group, self.all = sizes, group, has_all
        self.heads: dict[str, list[int]] = {}
        self.by_key: dict[int, list[int]] = {}
        for rank, e in enumerate(ordered):
            self.heads.setdefault(e["source"][: e["_size"]], []).append(rank)
            self.by_key.setdefault(e["_key"], []).append(rank)
        self.changed: list[tuple[int, str]] = []

    def begins(self, key: int, text: str, at: int) -> Iterator[int]:
        """Phrases with this key that begin there."""
        return (r for r in self.by_key.get(key, ()) if text.startswith(self.pairs[r][0], at))

    def replaced(self, text: str, waiting: set[int]) -> str | None:
        """The text with the phrases that it holds, and those that come up, replaced."""
        working = text
        while waiting:
            done = min(waiting)
            waiting.remove(done)
            source, target = self.pairs[done]
            parts = working.split(source)
            if len(parts) == 1:
                continue
            working, longest, at = target.join(parts), len(source), 0
            sizes = [n for n in self.sizes if n <= longest]
            for part in parts[:-1]:
                # What comes up holds a character of the target, or reaches over its place.
                at += len(part)
                near, far = max(0, at - longest + 1), at + len(target)
                for n in sizes:
                    for i in range(near, far):
                        for rank in self.heads.get(working[i : i + n], ()):
                            if rank > done and working.startswith(self.pairs[rank][0], i):
                                waiting.add(rank)
                self.changed.append((sizes[-1], working[near : far + sizes[-1] - 1]))
                at = far
        return None if working == text else working

    def whole_text(self, text: str, plain: str) -> tuple[str, str] | None:
        """Translation of a text as a whole, and how; ``plain`` is without footnote marks."""
        if text in self.whole:
            return self.whole[text], "exact"
        return (self.whole[plain], "plain") if plain in self.whole else None


def _contained(texts: list[str], tables: list[Phrases], sizes: list[int]) -> list[set[int]]:
    """Per text the phrases of its table that it holds."""
    keys = np.unique(np.array([k for t in {id(t): t for t in tables}.values() for k in t.by_key], dtype=np.int64))
    out: list[set[int]] = [set() for _ in texts]
    if not len(keys):
        return out
    slots = (1 << (16 * len(keys)).bit_length()) - 1
    some_key = np.zeros(slots + 1, dtype=bool)
    some_key[keys & slots] = True

    def known(found: np.ndarray) -> np.ndarray:
        may = some_key[found & slots]
        some = found[may]
        may[may] = keys[np.searchsorted(keys[:-1], some)] == some
        return may

    for found, text, at in windows(texts, [t.group for t in tables], sizes, known):
        for key, i, place in zip(found.tolist(), text.tolist(), at.tolist(), strict=True):
            out[i].update(tables[i].begins(key, texts[i], place))
    return out


def _missing(tables: list[Phrases], sizes: list[int], bits: np.ndarray) -> set[tuple[int, int]]:
    """(table, key) of windows around replacements that may be heads of phrases it has not."""
    out: set[tuple[int, int]] = set()
    for size in sizes:
        own = [(i, text) for i, t in enumerate(tables) if not t.all for n, text in t.changed if n == size]
        groups = [tables[i].group for i, _ in own]
        few = [n for n in sizes if n <= size]
        for keys, text, _ in windows([t for _, t in own], groups, few, lambda h: _may_be(bits, h)):
            for key, i in zip(keys.tolist(), text.tolist(), strict=True):
                if key not in tables[own[i][0]].by_key:
                    out.add((own[i][0], key))
    return out


def _work(
    runs: list[dict], ids: list[str], sizes: list[int], bits: np.ndarray | None
) -> Iterator[dict]:
    """Rows of some runs: texts with their translation, then windows to look up, of which a
    document of few phrases has none."""
    tables = [Phrases(r["_entries"], sizes, r["_group"], r["_all"]) for r in runs]
    texts = [(i, t) for i, r in enumerate(runs) for t in r["_texts"]]
    done: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
    for text, plain, prefix in (("_text", "_plain", ""), ("_bare", "_bare_plain", "untagged_")):
        left = []
        for j, (i, t) in enumerate(texts):
            if done[j][1] is None and t[text] is not None:
                whole = tables[i].whole_text(t[text], t[plain])
                if whole is None:
                    left.append(j)
                else:
                    done[j] = whole[0], prefix + whole[1]
        own = [tables[texts[j][0]] for j in left]
        plains = [texts[j][1][plain] for j in left]
        for j, table, form, waiting in zip(left, own, plains, _contained(plains, own, sizes), strict=True):
            made = table.replaced(form, waiting)
            if made is not None:
                done[j] = made, prefix + "phrase"
    for (i, t), (found, kind) in zip(texts, done, strict=True):
        yield {c: runs[i][c] for c in ids} | t | {"translated_text": found, "match_kind": kind}
    for i, key in () if bits is None else _missing(tables, sizes, bits):
        yield {c: runs[i][c] for c in ids} | {"_missing": key}


def _replace(runs: DataFrame, keys: list[str], out: T.StructType, sizes: list[int], bits) -> DataFrame:
    """Rows of `out` per text, or, with only keys, _run and _missing, windows to look up."""
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, RUNS_AT_A_TIME):
                some = batch.slice(a, RUNS_AT_A_TIME).to_pylist()
                rows = list(_work(some, [*keys, "_run"], sizes, bits and bits.value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow
                )

    return runs.mapInArrow(run, out)


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which nulls are equal; columns of the left side, then the others."""
    both = left.alias("x").join(
        right.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys], how
    )
    rest = [F.col(f"y.{c}") for c in right.columns if c not in keys and how != "left_semi"]
    return both.select("x.*", *rest)


def apply_translation_map(
    texts: DataFrame,
    tmap: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    untagged: bool = False,
) -> DataFrame:
    """Map texts through the translation map of their document.

    A text is taken as a whole, then without ``[N]`` marks, and else has every contained
    phrase replaced, longest first, equally long ones in the order of their first place in the
    map (``first_seq``, or ``seq`` where the map has none). With ``untagged``, a text with
    inline tags that nothing applies to is tried again without them. ``texts`` has ``keys, seq,
    text`` and any other columns, ``tmap`` has ``keys, source, target, seq``; adds
    ``translated_text`` (null when nothing applies) and ``match_kind``.

    A run holds at most ``TEXTS_PER_RUN`` positions of a document and the phrases that begin
    like a window of its texts, so the work grows with the texts and not with texts times
    phrases. Results are written to a table, once per round of phrases that come up.
    """
    k = list(keys)
    ids = [*k, "_run"]
    spark = texts.sparkSession

    def with_forms(text: Column, *more: Column) -> Column:
        trimmed = strip_ws(text)
        bare = F.when(text.rlike(TAG), strip_ws(strip_tags(text)))
        no = F.lit(None).cast("string")
        return F.struct(
            *more,
            trimmed.alias("_text"),
            F.regexp_replace(trimmed, FOOTNOTE_ANY, "").alias("_plain"),
            (bare if untagged else no).alias("_bare"),
            (F.regexp_replace(bare, FOOTNOTE_ANY, "") if untagged else no).alias("_bare_plain"),
        )

    own = [c for c in texts.columns if c not in keys]
    cut = texts.withColumns({"_run": bucket_of("seq", TEXTS_PER_RUN), "_group": F.xxhash64(*k)})
    index = materialise(_index(tmap, k), "phrases")
    sizes = sorted(r[0] for r in index.select("_size").distinct().collect())  # powers of two
    out = T.StructType(
        [
            *[T.StructField(c, cut.schema[c].dataType) for c in [*k, "_run", *own]],
            T.StructField("translated_text", T.StringType()),
            T.StructField("match_kind", T.StringType()),
            T.StructField("_missing", T.LongType()),
        ]
    )
    result = [*texts.columns, "translated_text", "match_kind"]
    if not sizes:
        return texts.select("*", *(F.lit(None).cast("string").alias(c) for c in result[-2:])).select(*result)
    entry = F.struct("source", "target", "_first", "_size", "_key").alias("_entry")
    many = materialise(
        index.groupBy("_group").count().filter(F.col("count") > FEW).select("_group"), "many_phrases"
    )
    few = index.join(many, "_group", "left_anti").select("_group", entry)
    runs_of = cut.select(*ids, "_group").distinct()
    found = runs_of.join(few, "_group").select(*ids, "_entry", F.lit(True).alias("_all"))
    bits = None
    if not many.isEmpty():
        rest = index.join(many, "_group", "left_semi")
        bits = spark.sparkContext.broadcast(_bits_of(rest))
        phrases = rest.select("_key", entry)

        def bring(windows: DataFrame) -> DataFrame:
            return windows.join(phrases, "_key").select(*ids, "_entry", F.lit(False).alias("_all"))

        looked = cut.join(many, "_group", "left_semi").select("*", with_forms(F.col("text")).alias("_f"))
        found = found.unionByName(bring(_probes(looked.select("*", "_f.*"), k, sizes, bits)))
        found = materialise(found, "run_phrases")  # again in each round

    def gathered(texts: DataFrame, found: DataFrame) -> DataFrame:
        """Runs with their texts and phrases, which meet in one shuffle."""
        text = texts.select(*ids, F.struct(*own).alias("_row"))
        both = text.unionByName(found, allowMissingColumns=True)
        grouped = both.groupBy(*ids).agg(
            F.collect_list("_row").alias("_rows"),
            F.collect_set("_entry").alias("_entries"),
            F.coalesce(F.bool_or("_all"), F.lit(False)).alias("_all"),
        )
        formed = F.transform("_rows", lambda r: with_forms(r["text"], *(r[c].alias(c) for c in own)))
        return grouped.select(*ids, formed.alias("_texts"), F.xxhash64(*k).alias("_group"), "_entries", "_all")

    todo, made = cut, None
    while True:
        done = materialise(_replace(gathered(todo, found), k, out, sizes, bits), "replaced")
        settled = done.filter("_missing IS NULL").select(*result, *(c for c in ids if c not in result))
        if bits is None:
            return settled.select(*result)
        asked = bring(done.filter("_missing IS NOT NULL").select(*ids, F.col("_missing").alias("_key")))
        more = materialise(asked, "run_phrases")
        again = more.select(*ids).distinct()
        if more.isEmpty():
            return (settled if made is None else made.unionByName(settled)).select(*result)
        kept = settled.alias("x").join(
            again.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ids], "left_anti"
        )
        made = kept if made is None else made.unionByName(kept)
        todo = _on(cut, again, ids, "left_semi")
        found = _on(found, again, ids, "left_semi").unionByName(more)


def translate_paragraphs(
    paragraphs: DataFrame, tmap: DataFrame, keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Tagged paragraphs through the map; ``match_kind`` of those that are only found
    without their tags begins with ``untagged_``."""
    return apply_translation_map(paragraphs, tmap, keys, untagged=True)
