"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import conversation_repair, decontaminate, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, token_codes, token_count, url_filter, whitening
from weftgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@register("op5_quality_rules")
def op5_quality_rules(spark, sf):
    judged = quality_rules.judged(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "wider_distance")


@register("op10_ngram_join")
def op10_ngram_join(spark, sf):
    return ngram_join.link(table(spark, sf, "documents"))


@register("op4_decontaminate")
def op4_decontaminate(spark, sf):
    found = decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "item_chars")


@register("op8_token_codes")
def op8_token_codes(spark, sf):
    return token_codes.round_trip(table(spark, sf, "documents"))


@register("op9_mixing")
def op9_mixing(spark, sf):
    return mixing.sampled(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES["pipeline"] = corpus_pipeline.run


@register("op1_url_filter", url_filter.SQL)
def op1_url_filter(spark, sf):
    return url_filter.judged(table(spark, sf, "pages"))


@register("op6_quality_classifier")
def op6_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf, "labels")))


@register("op2_token_count")
def op2_token_count(spark, sf):
    return token_count.counted(table(spark, sf, "documents"))


@register("op3_line_dedup", line_dedup.SQL)
def op3_line_dedup(spark, sf):
    return line_dedup.deduped(table(spark, sf, "pages"))


@register("op7_license_scan")
def op7_license_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return license_scan.scanned(docs, license_scan.train(docs))


@register("op13_packing")
def op13_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


@register("op12_whitening")
def op12_whitening(spark, sf):
    white = whitening.whitened(table(spark, sf, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))  # null beyond a long, as from about 10 million rows on


@register("op11_conversation_repair")
def op11_conversation_repair(spark, sf):
    return conversation_repair.judged(conversation_repair.damaged(table(spark, sf, "conversations")))
