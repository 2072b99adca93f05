"""Phrase collocations: candidates by Apriori, counted by walking double-array tries.

A piece of a text lies between the marks `. , ; : ! ?` and line ends; phrases lie in a piece.

1. `_words` counts words. `_level`, level by level: a phrase can only be frequent if all but its
   last word and all but its first are. Positions that pass are counted in Spark by the hash of
   the phrase without its last word and the hash of that word; a hash may stand for several
   phrases, so a count is an upper bound and no frequent phrase is missed. What passes a level
   is sent on as a bitmap of fixed size, which lets some others through. Joins on the hashes
   give the phrases: the candidates.
2. `_windows`: a block's longest stretches of up to `longest` words whose parts passed, each with
   how often it occurs there, go to the shard of their first two words, as ids into the words they
   use: a row per block and shard, so rows and passes over the texts do not grow with the shards.
3. `_walked`, one task at a time per shard of about ENTRIES candidates at most: `build` makes their
   double array. Symbols are the group and then words, as two digits each; a state's number is its
   cell. numpy moves the states of all stretches of a block one digit on at a time, drops those
   without a cell, and counts accepting states. These counts, exact on words, are the only ones
   that are used; those of single words are the counts of `_words`.

Scores, containment and ranks are joins and windows on the counts. Broadcasts never exceed a
bitmap per level; more candidates mean more shards, so `entries` should be what workers have
memory for (some 60 bytes each).

Defined results: a null text has no words, a null group is `und`; empty tables, and groups
without a frequent phrase, give no rows; repeated rows count again; ties of score go by count,
then by phrase in byte order; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.config import materialise
from locengine.llm.common import BITMAP_BITS, bitmap, slices
from locengine.llm.words import mixed

ENTRIES = 1 << 20  # of a shard: some 60 MB in a worker
BLOCK = 1 << 22  # bytes of text that are walked at a time
FEWEST = 1 << 12  # entries of a shard, where there are shards enough for all cores
SALTS = 64
_KIND = np.zeros(256, dtype=np.uint8)  # 0 of a word, 1 space, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\v\f\r"]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Words of a stretch of texts that stand one after the other, each with a line end behind.

    Word i is names[ids[i]] of group groups[i]; joined[i] says that word i + 1 follows in the
    same piece. Phrases are counted that start at the first `starts` words; the others belong
    to the next block.
    """

    def __init__(self, data: bytes, own: int, at: int, bounds: np.ndarray, groups: np.ndarray):
        codes = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[codes]
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False)).astype(np.int32)
        first = edges[::2]
        self.starts = int(np.searchsorted(first, own))
        if len(edges):
            cells = pa.BinaryArray.from_buffers(
                pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]
            ).dictionary_encode()
            self.ids = cells.indices.to_numpy()[::2]
            self.cells = cells.dictionary
        else:
            self.ids, self.cells = np.zeros(0, dtype=np.int32), pa.array([], pa.binary())
        self.names = self.cells.to_pylist()
        ends = np.cumsum(kind == 2, dtype=np.int32)
        self.joined = np.zeros(len(first), dtype=bool)
        self.joined[:-1] = ends[first[1:]] == ends[first[:-1]] if len(first) else False
        self.groups = groups[np.searchsorted(bounds, first + at, side="right") - 1]

    def hashes(self, groups: list[str]) -> np.ndarray:
        """One hash per word and group."""
        return _hashes(self.names, groups, self.ids, self.groups)

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.names[k] for k in self.ids[i : i + n].tolist())


def _hashes(words: list[bytes], groups: list[str], ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    salt = np.array([xxhash.xxh3_64_intdigest(g.encode(), seed=1) for g in groups], dtype=np.uint64)
    return mixed(own[ids] ^ salt[of]) if len(ids) else np.zeros(0, dtype=np.uint64)


def _longer(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all its words but the last, and of the last."""
    return mixed(before * _STEP + last)


def _ahead(longest: int) -> re.Pattern:
    return re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % (longest - 1))


_WORD_END = re.compile(rb"[ \t.,;:!?\n-\r]")


def blocks(texts: list[bytes | None], groups: list[str], longest: int) -> Iterator[tuple[Block, list[str]]]:
    """Blocks of these texts, and the groups that their numbers stand for.

    A long text is cut at the end of a word; the words of phrases that reach over the cut are
    read by both blocks and start in one.
    """
    names = sorted(set(groups))
    number = np.array([names.index(g) for g in groups], dtype=np.int32)
    data = b"\n".join([*((t or b"").lower() for t in texts), b""])
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts[:-1])])
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > 2 * BLOCK:
            end = _WORD_END.search(data, at + BLOCK)
            to = end.end() if end else to
        after = to if data[to - 1 : to] in (b"\n", b"") else _ahead(longest).match(data, to).end()
        yield Block(data[at:after], to - at, at, bounds, number), names
        at = to


def _scan(df: DataFrame, longest: int, compute, schema: str) -> DataFrame:
    """Rows that compute(blocks of a task) yields, as lists of arrays in the schema's order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for a, b, texts in slices(batch.column(0), BLOCK):
                    groups = batch.column(1).slice(a, b - a).to_pylist()
                    yield from blocks(texts, groups, longest)

        for columns in compute(stream()):
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _bits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.int64) % BITMAP_BITS
    return (words[slot // 64] >> (slot % 64)) & 1 == 1


def _words(df: DataFrame) -> DataFrame:
    """(grp, word, n): occurrences of every word, and, with a null word, of all."""

    def compute(found):
        for block, groups in found:
            if not block.starts:
                continue
            size = len(block.names)
            own = block.groups[: block.starts].astype(np.int64) * size + block.ids[: block.starts]
            both, counts = np.unique(own, return_counts=True)
            of = pa.array(groups)
            yield [of.take(pa.array(both // size)), block.cells.take(pa.array(both % size)), pa.array(counts)]
            sums = np.bincount(block.groups[: block.starts], minlength=len(groups))
            yield [of, pa.nulls(len(groups), pa.binary()), pa.array(sums)]

    found = _scan(df, 1, compute, "grp string, word binary, n long")
    return found.groupBy("grp", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _keyed(df: DataFrame) -> DataFrame:
    """(grp, phrase) with the hash of a word, or of a phrase from its parts (before, last), and the
    hash of the first two words: `pair`, or where that is null the phrase's own."""
    parts = "before" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, phrase = batch.column(0), batch.column(1)
            if parts:
                before, last = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3))
                key = _longer(before, last)
            else:
                of = grp.dictionary_encode()
                words = [w.encode() for w in phrase.to_pylist()]
                at = np.arange(len(words))
                key = _hashes(words, of.dictionary.to_pylist(), at, of.indices.to_numpy())
            key = pa.array(key.view(np.int64))
            pair = pc.coalesce(batch.column(4), key) if parts else key
            yield pa.RecordBatch.from_arrays(
                [grp, phrase, key, pair], ["grp", "phrase", "key", "pair"]
            )

    return df.mapInArrow(run, "grp string, phrase string, key long, pair long")


def _positions(block: Block, groups: list[str], passed: list, n: int) -> tuple[np.ndarray, ...]:
    """Of phrases of n words that may be frequent, by all shorter ones in them: the hash of all
    words but the last, and of the last."""
    word = keys = block.hashes(groups)
    good = np.ones(len(keys), dtype=bool)
    for k in range(1, n):
        before = keys
        good &= _bits(passed[k - 1], keys)
        good = good[:-1] & good[1:] & block.joined[: len(good) - 1]
        keys = _longer(keys[:-1], word[k:])
    at = np.flatnonzero(good[: block.starts])
    return before[at], word[at + n - 1]


def _counted(before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs and how often they occur; pairs are compared, not only their hashes."""
    key = _longer(before, last)
    order = np.argsort(key)
    before, last, key = before[order], last[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (before[1:] != before[:-1]) | (last[1:] != last[:-1])
    starts = np.flatnonzero(new)
    return before[starts], last[starts], np.diff(np.append(starts, len(key)))


def _level(df: DataFrame, longest: int, n: int, passed: list, least: int) -> DataFrame:
    """(before, last): of phrases of n words that occur often enough, or share hashes that do."""
    shared = df.sparkSession.sparkContext.broadcast(passed)

    def compute(found):
        for block, groups in found:
            before, last = _positions(block, groups, shared.value, n)
            if len(before):
                first, second, counts = _counted(before, last)
                yield [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(counts)]

    found = _scan(df, longest, compute, "before long, last long, n long")
    summed = found.groupBy("before", "last").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least).select("before", "last")


def candidates(df: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(grp, phrase, pair): every phrase of 2 to `longest` words that `least` occurrences can have,
    some with fewer, and the hash of its first two words; (grp, phrase, f): words that occur so
    often; (grp, n): all words; and the bitmaps that phrases of 1, 2 ... words pass."""
    counted = materialise(_words(df).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counted.where("word is null").select("grp", "n")
    frequent = counted.where("word is not null").where(F.col("n") >= least)
    frequent = frequent.select("grp", F.col("word").alias("phrase"), F.col("n").alias("f"))
    words = materialise(_keyed(frequent.select("grp", "phrase")), "words")
    last = words.select(F.col("grp").alias("of"), F.col("phrase").alias("word"), F.col("key").alias("last"))
    passed, have, phrases = [bitmap(words, "key")], words, None
    for n in range(2, longest + 1):
        found = _level(df, longest, n, passed, least)
        before = have.withColumnRenamed("key", "before")
        both = found.join(before, "before").join(last, "last").where("of = grp")
        longer = F.concat_ws(" ", "phrase", "word").alias("phrase")
        pair = (F.lit(None).cast("long") if n == 2 else F.col("pair")).alias("pair")
        have = materialise(_keyed(both.select("grp", longer, "before", "last", pair)), "phrases")
        phrases = have if phrases is None else phrases.unionByName(have)
        passed.append(bitmap(have, "key"))
    return phrases.select("grp", "phrase", "pair").distinct(), frequent, totals, passed


def _first_fit(taken: np.ndarray, low: int, top: int, digits: np.ndarray) -> tuple[int, int]:
    """A base that puts all digits on free cells, and from where to look next."""
    for k in range(4):
        bases = low + 32 * k + np.arange(32)
        clash = taken[bases[:, None] + digits].any(1)
        j = int(clash.argmin())
        if not clash[j]:
            return int(bases[j]), low + 32 * (k > 0)
    return top, low + 32


def build(symbols: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array (base, check, accept) of rows of symbols, padded with -1, none repeated.

    From state s, digit d leads to cell base[s] + d if check of that cell is s; accept of the
    last cell is the row's number. The root is cell 0.
    """
    n, width = symbols.shape
    digits = np.full((n, 2 * width), -1, dtype=np.int32)
    real = symbols >= 0
    digits[:, 0::2] = np.where(real, symbols // radix, -1)
    digits[:, 1::2] = np.where(real, symbols % radix, -1)
    order = np.lexsort(digits.T[::-1])
    digits = digits[order]
    taken = np.zeros(4 * radix + 1024, dtype=bool)
    base = np.zeros(len(taken), dtype=np.int32)
    check = np.full(len(taken), -1, dtype=np.int32)
    state, low, top = np.zeros(n, dtype=np.int64), radix, radix

    def room(cells: int) -> None:
        nonlocal taken, base, check
        if cells > len(taken):
            more = max(cells, 2 * len(taken)) - len(taken)
            taken = np.concatenate([taken, np.zeros(more, dtype=bool)])
            base = np.concatenate([base, np.zeros(more, dtype=np.int32)])
            check = np.concatenate([check, np.full(more, -1, dtype=np.int32)])

    for level in range(2 * width):
        rows = np.flatnonzero(digits[:, level] >= 0)
        if not len(rows):
            break
        s, d = state[rows], digits[rows, level]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
        parent, digit = s[new], d[new]
        starts = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        sizes = np.diff(np.append(starts, len(parent)))
        many = np.flatnonzero(sizes > 1)
        for k in many[np.argsort(-sizes[many], kind="stable")].tolist():
            own = digit[starts[k] : starts[k] + sizes[k]]
            room(top + 2 * radix + 256)
            at, low = _first_fit(taken, low, top, own)
            taken[at + own] = True
            base[parent[starts[k]]] = at
            top = max(top, at + int(own[-1]) + 1)
        one = starts[sizes == 1]
        free = radix + np.flatnonzero(~taken[radix:top])[: len(one)]
        free = np.concatenate([free, top + np.arange(len(one) - len(free))])
        top = max(top, int(free[-1]) + 1) if len(free) else top
        room(top + 2 * radix + 256)
        taken[free] = True
        base[parent[one]] = free - digit[one]
        cell = base[parent] + digit
        check[cell] = parent
        state[rows] = cell[np.cumsum(new) - 1]
    size = top + radix
    accept = np.full(size, -1, dtype=np.int32)
    accept[state] = order
    return base[:size], check[:size], accept


def _build_shard(grp: pa.Array, phrase: pa.Array) -> bytes:
    """The trie of these phrases, which stand at their numbers."""
    parts = pc.split_pattern(phrase, " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    words, groups = pc.list_flatten(parts).dictionary_encode(), grp.dictionary_encode()
    symbols = np.full((len(phrase), int(sizes.max()) + 1), -1, dtype=np.int64)
    symbols[:, 0] = groups.indices.to_numpy() + len(words.dictionary)
    row = np.repeat(np.arange(len(phrase)), sizes)
    symbols[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        words.indices.to_numpy()
    )
    radix = max(2, math.isqrt(len(words.dictionary) + len(groups.dictionary)) + 1)
    vocabulary = b"\n".join(w.encode() for w in words.dictionary.to_pylist())
    return pickle.dumps((radix, *build(symbols, radix), vocabulary, groups.dictionary.to_pylist()))


class Trie:
    """A shard as workers use it."""

    def __init__(self, made: bytes):
        radix, self.base, self.check, self.accept, vocabulary, groups = pickle.loads(made)
        self.radix = radix
        names = vocabulary.split(b"\n")
        self.words = {w: i for i, w in enumerate(names)}
        self.roots = {}
        for i, g in enumerate(groups, len(names)):
            s = np.zeros(1, dtype=np.int64)
            for d in (i // radix, i % radix):
                s = self.base[s] + np.int64(d)
            self.roots[g] = int(s[0])

    def step(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which are there."""
        cell = self.base[state] + digit
        return cell, self.check[cell] == state

    def reached(
        self, block: Block | Windows, groups: list[str], longest: int, at: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which of the words `at` begin a phrase, and its number, per number of words."""
        symbol = np.array([self.words.get(w, -1) for w in block.names], dtype=np.int64)
        high, low = symbol // self.radix, symbol % self.radix
        roots = np.array([self.roots.get(g, -1) for g in groups], dtype=np.int64)
        state, of = roots[block.groups[at]], np.arange(len(at))
        keep = state >= 0
        for k in range(longest):
            if k:
                keep = block.joined[at + k - 1]
            of, at, state = of[keep], at[keep], state[keep]
            name = block.ids[at + k]
            known = symbol[name] >= 0
            of, at, state, name = of[known], at[known], state[known], name[known]
            for digits in (high, low):
                state, keep = self.step(state, digits[name])
                of, at, state, name = of[keep], at[keep], state[keep], name[keep]
            number = self.accept[state]
            yield of[number >= 0], number[number >= 0]
            keep = np.ones(len(at), dtype=bool)

    def accepted(self, block: Block, groups: list[str], longest: int) -> Iterator[np.ndarray]:
        """Numbers of the phrases at all positions, one array per number of words."""
        for _, number in self.reached(block, groups, longest, np.arange(block.starts)):
            yield number


class Windows:
    """Stretches of words one after the other: words names[ids[i]] of group groups[i], of which
    joined[i] says that the next one follows; stretch k begins at starts[k] and occurs counts[k]
    times."""

    def __init__(self, made: bytes):
        names, ids, sizes, self.counts, groups, self.of = pickle.loads(made)
        self.names, self.ids = names.split(b"\n"), ids.astype(np.int64)
        ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = ends - sizes
        self.joined = np.ones(len(ids), dtype=bool)
        self.joined[ends - 1] = False
        self.groups = np.repeat(groups, sizes)


def _packed(block: Block, groups: list[str], passed: list, shards: int) -> Iterator[tuple[int, bytes]]:
    """Per shard the stretches of a block that may be or begin with candidates: from each word
    the longest one of which all parts passed, if it has two words or more."""
    word = keys = block.hashes(groups)
    good = _bits(passed[0], keys)
    reach, pair, whole = np.ones(len(keys), dtype=np.uint8), keys, keys.copy()
    for k in range(1, len(passed)):
        keys = _longer(keys[:-1], word[k:])
        good = good[:-1] & good[1:] & block.joined[: max(0, len(good) - 1)]
        good &= _bits(passed[k], keys)
        pair = keys if k == 1 else pair
        at = np.flatnonzero(good)
        reach[at] = k + 1
        whole[at] = keys[at]
    at = np.flatnonzero(reach[: block.starts] > 1)
    at = at[np.argsort(whole[at])]
    if not len(at):
        return
    # The same stretches stand together; words are compared, not only hashes.
    words = np.full((len(at), len(passed)), -1, dtype=np.int32)
    for k in range(len(passed)):
        some = reach[at] > k
        words[some, k] = block.ids[at[some] + k]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (words[1:] != words[:-1]).any(1) | (block.groups[at[1:]] != block.groups[at[:-1]])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at))).astype(np.int32)
    at, words = at[first], words[first]
    shard = pair[at].view(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[i] : edges[i + 1]]
        cells = words[own]
        used, ids = np.unique(cells[cells >= 0], return_inverse=True)
        names = b"\n".join(block.cells.take(pa.array(used)).to_pylist())
        of = block.groups[at[own]].astype(np.int32)
        yield i, pickle.dumps((names, ids.astype(np.int32), reach[at[own]], counts[own], of, groups))


def _windows(df: DataFrame, longest: int, passed: list, shards: int) -> DataFrame:
    """(shard, windows): stretches of words, a row per block and shard."""
    shared = df.sparkSession.sparkContext.broadcast(passed)

    def compute(found):
        for block, groups in found:
            for shard, made in _packed(block, groups, shared.value, shards):
                yield [pa.array([shard], pa.int32()), pa.array([made], pa.binary())]

    return _scan(df, longest, compute, "shard int, windows binary")


def _walked(rows: DataFrame, longest: int) -> DataFrame:
    """(grp, phrase, f) from (shard, grp, phrase, windows): the phrases of a shard or stretches."""
    arrow = pa.schema([("grp", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    class Counts:
        """Of one shard; what is found waits until it is worth adding up."""

        def __init__(self, grp: pa.Array, phrase: pa.Array):
            self.columns, self.trie = [grp, phrase], Trie(_build_shard(grp, phrase))
            self.total, self.held, self.waiting = np.zeros(len(grp), dtype=np.int64), [], 0

        def walk(self, made: bytes) -> None:
            windows = Windows(made)
            for of, number in self.trie.reached(windows, windows.of, longest, windows.starts):
                self.held.append((number, windows.counts[of]))
                self.waiting += len(of)
            if self.waiting > len(self.total):
                self.add()

        def add(self) -> None:
            number, count = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.total += np.bincount(number, count, len(self.total)).astype(np.int64)
            self.held, self.waiting = [], 0

        def done(self) -> pa.RecordBatch:
            if self.held:
                self.add()
            at = pa.array(np.flatnonzero(self.total))
            columns = [c.take(at) for c in [*self.columns, pa.array(self.total)]]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, counts = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != now:
                    if counts is not None:
                        yield counts.done()
                    now, phrases, counts = shards[a], [], None
                part = batch.slice(a, b - a)
                found = part.column(3).is_valid()
                own = part.filter(pc.invert(found))
                if own.num_rows:
                    phrases.append([c.cast(pa.string()) for c in (own.column(1), own.column(2))])
                for made in part.column(3).filter(found):
                    if counts is None and phrases:
                        counts = Counts(*(pa.concat_arrays(c) for c in zip(*phrases, strict=True)))
                        phrases = []
                    if counts is not None:
                        counts.walk(made.as_py())
        if counts is not None:
            yield counts.done()

    sorted_ = rows.repartition("shard").sortWithinPartitions("shard", F.col("windows").isNotNull())
    return sorted_.mapInArrow(run, "grp string, phrase string, f long")


def phrase_counts(
    df: DataFrame, longest: int = 3, least: int = 10, entries: int = ENTRIES
) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, f) of all candidates and of frequent words, and (grp, n), all words, from a
    table (text, grp). Texts are read once a level, and once more."""
    made, words, totals, passed = candidates(df, longest, least)
    found = materialise(made, "candidates")
    count = found.count()
    if not count:
        return words.limit(0), totals
    cores = 8 * df.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-count // entries), min(cores, -(-count // FEWEST)))
    shard = F.pmod("pair", F.lit(shards)).cast("int").alias("shard")
    own = found.select(shard, "grp", "phrase", F.lit(None).cast("binary").alias("windows"))
    nothing = F.lit(None).cast("string")
    stretches = _windows(df, longest, passed, shards).select(
        "shard", nothing.alias("grp"), nothing.alias("phrase"), "windows"
    )
    counts = materialise(_walked(own.unionByName(stretches), longest), "counts")
    return counts.unionByName(words), totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in 38 decimal digits, enough for counts up to 10**16."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(
    df: DataFrame,
    text: str = "text",
    group: str = "lang",
    longest: int = 3,
    least: int = 10,
    inside: int = 50,
    first: int = 2000,
    entries: int = ENTRIES,
) -> DataFrame:
    """Per group its `first` phrases: group, rank, phrase, a, l, r, n, score.

    a is a phrase's count, l and r those of the two sides of its weakest cut (the least k of
    equal scores), n all words of the group. A phrase goes that stands within a longer
    candidate which occurs at least `inside` percent as often.
    """
    texts = df.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("grp"),
    )
    counts, totals = phrase_counts(texts, longest, least, entries)
    words = F.split("phrase", " ")
    all_ = counts.where(F.instr("phrase", " ") > 0).where(F.col("f") >= least)
    all_ = all_.select("grp", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = all_.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {
            "head": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "),
            "tail": F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " "),
        }
    )
    heads = counts.select("grp", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("grp", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["grp", "head"]).join(tails, ["grp", "tail"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    weakest = cuts.groupBy("grp", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c")
    )
    longer = all_.where(F.size("w") > 2).select("grp", "a", "w")
    size = F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size")
    parts = longer.select("*", size).select(
        "grp",
        "a",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("size") + 1),
                lambda i: F.array_join(F.slice("w", i, F.col("size")), " "),
            )
        ).alias("phrase"),
    )
    most = parts.groupBy("grp", "phrase").agg(F.max("a").alias("longer"))
    own = weakest.join(most, ["grp", "phrase"], "left")
    own = own.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    own = own.select("grp", "phrase", "a", "c.l", "c.r", "c.score")
    return _ranked(own, first).join(totals, "grp").select(
        F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _ranked(df: DataFrame, first: int) -> DataFrame:
    """The first rows of each group, found in SALTS parts of it and then among theirs."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = Window.partitionBy("grp", "part").orderBy(*order)
    far = Window.partitionBy("grp").orderBy(*order)
    few = df.withColumn("part", part).withColumn("rank", F.row_number().over(near))
    few = few.where(F.col("rank") <= first).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(far).cast("long"))
    return ranked.where(F.col("rank") <= first)
