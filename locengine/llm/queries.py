"""The operators over whole tables, one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locengine.config import new_path
from locengine.llm import (
    chat,
    collocations,
    decontaminate,
    fingerprints,
    html,
    jaccard,
    langid,
    licenses,
    mixing,
    substrings,
    urls,
    warc,
    whitening,
)
from locengine.llm.common import prepare

RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, d: fn(prepare(spark), d)
    return fn


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_html_extraction(spark, d):
    pages = _table(spark, d, "pages").select("page_id", "url", "html")
    made = html.extract_text(pages)
    return made.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


@query
def op2_decontamination(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    made = decontaminate.decontaminate(docs, _table(spark, d, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return made.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


@query
def op3_license_scan(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    made = licenses.scan_licenses(docs)
    return made.select(
        "doc_id",
        "license",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.concat_ws(",", "licenses.license").alias("licenses"),
        F.concat_ws(",", F.transform("licenses", lambda x: x["first"].cast("string"))).alias(
            "places"
        ),
        F.size(F.flatten(F.col("licenses.differences"))).cast("long").alias("n_differences"),
    )


@query
def op4_url_filter(spark, d):
    pages = _table(spark, d, "pages").select("page_id", "url", "html")
    made = urls.filter_urls(pages, RULES)
    return made.select(
        "page_id", "host", "path", "rule", "verdict", F.concat_ws(" ", "words").alias("words")
    )


@query
def op5_fingerprints(spark, d):
    return fingerprints.compare_with_next(_table(spark, d, "documents").select("doc_id", "text"))


@query
def op6_jaccard_join(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return jaccard.near_groups(docs, n=3, percent=90).withColumnRenamed("id", "doc_id")


@query
def op7_warc(spark, d):
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, d, "pages").select("page_id", "url", "html"), path)
    back = warc.read_archives(spark, path).where("gap is null")
    number = r"^<urn:row:(-?[0-9]+)>$"

    def id_of(c):
        found = F.regexp_extract(c, number, 1)
        return F.when(found != "", found.cast("long"))

    return back.select(
        id_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        id_of("refers_to").alias("refers_to"),
    )


@query
def op8_language_id(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.where(~langid.held_out("doc_id")).select("text", "lang"))
    made = langid.identify(docs.select("doc_id", "text"), net)
    return made.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op9_mixing(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "source", "text")
    made = mixing.mix(docs, max_repeats=2.0).drop("text")
    return made.withColumn("weight", F.round("weight", 9))


@query
def op10_substring_dedup(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    made = substrings.remove_repeats(docs, window=35)
    return made.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_whitening(spark, d):
    return whitening.whiten(_table(spark, d, "embeddings").select("vec_id", "embedding"))


@query
def op12_chat_format(spark, d):
    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    both = turns.unionByName(more)
    made = chat.digest(chat.format_turns(both)).alias("d")
    checked = chat.validate(both).alias("v")
    return made.join(checked, F.expr("d.conv_id <=> v.conv_id")).select("d.*", "v.valid", "v.wrong_turn")


@query
def op13_collocations(spark, d):
    return collocations.collocations(_table(spark, d, "documents").select("text", "lang"))
