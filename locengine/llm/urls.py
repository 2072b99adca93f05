"""URL filters: rules first, then a naive Bayes model over words of host and path.

A host often joins words. The words of all pages, counted in Spark, are a unigram model by which
Viterbi splits every letter run of a host label into its likeliest words. A multinomial
naive Bayes model is trained on the pages that a rule decides, over the words of host and
path, and judges the others. Words are hashed into `BUCKETS` features, so that the model has a
fixed size; words that share a feature share their counts.

The host is what follows the first :// up to a slash, question mark, number sign or the end,
with A-Z in lower case; the path follows up to a question mark or number sign. Null urls and urls
without :// have an empty host and path, fit no rule and are judged by the class sizes. Without
pages of one class, all others get the other class; without any, allow. Ties are allowed.
Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from locengine.config import materialise
from locengine.llm.common import free_name, without

BUCKETS = 1 << 16
LONGEST = 20  # letters of a word of the unigram model
_TAG = re.compile(rb"<[^>]*>")
_WORD = re.compile(rb"[a-z]+")
OUTPUTS = ["host", "path", "rule", "verdict", "words", "block_score"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    u = F.coalesce(F.col(f"`{url}`") if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        own = (host == rule.host) | host.endswith("." + rule.host)
        fits = own & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """(word, count) of the letter runs of all pages outside tags, A-Z in lower case."""
    ddl = "word string, count long"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for raw in batch.column(0).to_pylist():
                if raw:
                    seen.update(_WORD.findall(_TAG.sub(b" ", raw).lower()))
            words = [w for w in seen if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in words]), pa.array([seen[w] for w in words])],
                schema=arrow,
            )

    raw = pages.select(F.col(f"`{html}`").cast("binary").alias("raw"))
    return raw.mapInArrow(run, ddl).groupBy("word").agg(F.sum("count").alias("count"))


def segmented(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a letter run; unknown words get rarer by their length."""
    best = [0.0]
    last = [0]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            count = counts.get(run[start:end], 0)
            if count:
                score = math.log(count / total)
            else:
                score = math.log(10 / total) - (end - start) * math.log(10)
            options.append((best[start] + score, start))
        score, start = max(options)
        best.append(score)
        last.append(start)
    words, end = [], len(run)
    while end:
        words.append(run[last[end] : end])
        end = last[end]
    return words[::-1]


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct letter runs: each meets the counts of its substrings only."""
    total = max(1, counts.agg(F.sum("count")).first()[0] or 0)
    starts = F.sequence(F.lit(1), F.greatest(F.length("run"), F.lit(1)))
    size = F.least(F.lit(LONGEST), F.length("run") - F.col("start") + 1)
    parts = (
        runs.select("run", F.explode(starts).alias("start"))
        .select("run", "start", F.explode(F.sequence(F.lit(1), size)).alias("size"))
        .select("run", F.expr("substring(run, start, size)").alias("word"))
        .distinct()
    )
    known = (
        parts.join(counts, "word")
        .groupBy("run")
        .agg(F.collect_list(F.struct("word", "count")).alias("known"))
    )
    ddl = "run string, words array<string>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            known = [{w["word"]: w["count"] for w in k or ()} for k in batch.column(1).to_pylist()]
            words = [segmented(n, k, total) for n, k in zip(names, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))],
                schema=arrow,
            )

    return runs.join(known, "run", "left").select("run", "known").mapInArrow(run, ddl)


def hosts_with_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts; digits stay as they are."""
    pieces = hosts.select(
        "host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), 0))
    ).withColumnRenamed("col", "run")
    letters = pieces.where(F.col("run").rlike("^[a-z]")).select("run").distinct()
    split = split_runs(letters, counts)
    words = F.coalesce("words", F.array("run"))
    return (
        pieces.join(split, "run", "left")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("pos", words.alias("words")))).alias("all"))
        .select("host", F.flatten(F.col("all.words")).alias("words"))
    )


def _features(words: Column, path: Column) -> Column:
    """Host words and path words, kept apart, as feature numbers."""
    host = F.transform(words, lambda w: F.concat(F.lit("host "), w))
    lower = F.translate(path, string.ascii_uppercase, string.ascii_lowercase)
    parts = F.filter(F.split(lower, r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: w != "")
    paths = F.transform(parts, lambda w: F.concat(F.lit("path "), w))
    return F.transform(
        F.concat(host, paths), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    )


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each feature for block against allow, and that of the class sizes, from rows
    (verdict, features)."""
    sizes = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    weights = np.zeros(BUCKETS)
    block, allow = sizes.get("block", 0), sizes.get("allow", 0)
    if not block or not allow:
        return weights, float(bool(block) - bool(allow))
    counts = rows.select("verdict", F.explode("features").alias("feature"))
    table = counts.groupBy("verdict", "feature").count().toArrow()
    seen = np.zeros((2, BUCKETS))
    of = np.array([v == "block" for v in table.column("verdict").to_pylist()], dtype=int)
    seen[of, table.column("feature").to_numpy()] = table.column("count").to_numpy()
    share = (seen + 1) / (seen.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(share[1] / share[0]), math.log(block / allow)


def _score(rows: DataFrame, weights: np.ndarray, prior: float) -> DataFrame:
    """The rows with block_score instead of features."""
    at = rows.columns.index("features")
    kept = [c for c in rows.columns if c != "features"]
    schema = StructType([rows.schema[c] for c in kept] + [StructField("block_score", DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(at)
            sizes = np.diff(features.offsets.to_numpy())
            of = np.repeat(np.arange(len(sizes)), sizes)
            own = shared.value[features.flatten().to_numpy()]
            sums = prior + np.bincount(of, own, minlength=len(sizes))
            others = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sums)], schema=arrow)

    return rows.mapInArrow(run, schema)


def filter_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html"
) -> DataFrame:
    """The pages without the html column, with host, path, rule, verdict, words (of the host) and
    block_score. Columns of the input with these names are replaced."""
    counts = materialise(word_counts(pages, html), "words")
    host, path = host_and_path(url)
    own = without(pages, [*OUTPUTS, html])
    kept = [c for c in own.columns]
    ruled = free_name(own, "ruled")
    names = F.col("host"), F.col("path")
    base = without(pages, [x for x in [*OUTPUTS, html] if x.lower() != url.lower()])
    base = base.select(
        *(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path")
    )
    rule, verdict = fitting_rule(*names, rules)
    base = base.withColumns({"rule": rule, ruled: verdict})
    hosts = base.select("host").distinct()
    words = materialise(hosts_with_words(hosts, counts), "hosts")
    none = F.array().cast(ArrayType(StringType()))
    rows = base.join(words, "host", "left").withColumn("words", F.coalesce("words", none))
    rows = rows.withColumn("features", _features(F.col("words"), F.col("path")))
    known = rows.where(F.col(ruled).isNotNull())
    weights, prior = train(known.select(F.col(ruled).alias("verdict"), "features"))
    scored = _score(rows, weights, prior)
    judged = F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    scored = scored.withColumn("verdict", F.coalesce(F.col(ruled), judged))
    return scored.select(*(F.col(f"`{c}`") for c in kept), *OUTPUTS)
