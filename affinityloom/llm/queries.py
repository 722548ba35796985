"""The operators bound to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinityloom.llm import (
    byte_bpe, classifiers, collocations, decontaminate, jaccard_join, kneser_ney, line_dedup, media, packing, secret_ledger, spelling,
    token_codes,
)
from affinityloom.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@_register("op2_secret_ledger")
def _op2(spark, sf_dir):
    return secret_ledger.secret_digest(_docs(spark, sf_dir))


@_register("op7_line_dedup")
def _op7(spark, sf_dir):
    return line_dedup.line_dedup_digest(_docs(spark, sf_dir))


@_register("op10_byte_bpe")
def _op10(spark, sf_dir):
    import public_tokenizers as tokenizers

    return byte_bpe.encode_texts(
        _docs(spark, sf_dir), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ["doc_id"])


@_register("op4_benchmark_decontamination")
def _op4(spark, sf_dir):
    return decontaminate.decontamination_digest(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))


@_register("op5_token_codes")
def _op5(spark, sf_dir):
    import public_tokenizers as tokenizers

    return token_codes.token_codes(_docs(spark, sf_dir), tokenizers.path("byte_bpe_50k.json"))


def toxicity_model(spark, sf_dir):
    rows, totals = classifiers.labelled_sample(
        _docs(spark, sf_dir), _docs(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, classifiers.FIT_ROWS)
    return classifiers.fit_toxicity(rows, totals=totals)


@_register("op3_toxicity")
def _op3(spark, sf_dir):
    scored = toxicity_model(spark, sf_dir).score(_docs(spark, sf_dir).select("doc_id", "text"))
    return classifiers.digest(scored, fold("doc_id", 5) == 0)


@_register("op8_quality_ranking")
def _op8(spark, sf_dir):
    docs, labels, training = _docs(spark, sf_dir), _docs(spark, sf_dir, "labels"), fold("doc_id", 3) != 1
    rows, _ = classifiers.labelled_sample(docs, labels, "quality", training, classifiers.PAIR_SIDE)
    model = classifiers.fit_quality(rows)
    if model.weights.any():
        model.threshold = classifiers.score_quantile(model, docs, classifiers.known_labels(labels, "quality", training))
    scored = model.score(docs.select("doc_id", "text"))
    return classifiers.digest(scored, fold("doc_id", 3) == 1)


@_register("op1_jaccard_join")
def _op1(spark, sf_dir):
    return jaccard_join.jaccard_digest(_docs(spark, sf_dir))


@_register("op6_media_columns")
def _op6(spark, sf_dir):
    return media.media_digest(_docs(spark, sf_dir))


@_register("op9_kneser_ney")
def _op9(spark, sf_dir):
    return kneser_ney.lm_digest(_docs(spark, sf_dir))


@_register("op11_sequence_packing")
def _op11(spark, sf_dir):
    import public_tokenizers as tokenizers

    return packing.packing_digest(_docs(spark, sf_dir), tokenizers.path("word_bpe_49k.json"))


@_register("op13_spelling_variants")
def _op13(spark, sf_dir):
    return spelling.spelling_variants(_docs(spark, sf_dir))


@_register("op12_phrase_collocations")
def _op12(spark, sf_dir):
    return collocations.collocations(_docs(spark, sf_dir))


SQL["op12_phrase_collocations"] = collocations.SQL
