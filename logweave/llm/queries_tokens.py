"""Queries of the tokenizing operators."""

from __future__ import annotations

import public_tokenizers

from logweave.llm import bpe, viterbi
from logweave.llm.registry import query, table


@query("op8_token_counts")
def _op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return viterbi.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_bpe_round_trip")
def _op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
