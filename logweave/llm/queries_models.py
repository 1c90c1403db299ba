"""Queries of the trained models; each learns outside its held-out fold only."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.llm import language, quality, toxicity
from logweave.llm.registry import query, table
from logweave.llm.text import fold


def _scored(module, spark, sf, label, modulus, remainder):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = fold("doc_id", modulus, remainder)
    model = module.train(docs, table(spark, sf, "labels"), label, held_out)
    scored = module.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= module.THRESHOLD).cast("int").alias("predicted")
    )


@query("op1_quality")
def _op1(spark, sf):
    return _scored(quality, spark, sf, "quality", 4, 2)


@query("op2_toxicity")
def _op2(spark, sf):
    return _scored(toxicity, spark, sf, "toxic", 3, 1)


@query("op6_language")
def _op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4, 2)
    found = language.predict(docs, language.train(docs, held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
