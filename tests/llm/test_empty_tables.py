import public_tokenizers as tokenizers
import pytest

from affinityloom.llm import byte_bpe, classifiers, decontaminate, jaccard_join, kneser_ney, line_dedup, media, secret_ledger, token_codes

BPE = tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "jaccard": jaccard_join.jaccard_digest,
    "secrets": secret_ledger.secret_digest,
    "codes": lambda d: token_codes.token_codes(d, tokenizers.path("byte_bpe_50k.json")),
    "media": media.media_digest,
    "lines": line_dedup.line_dedup_digest,
    "lm": kneser_ney.lm_digest,
    "bpe": lambda d: byte_bpe.encode_texts(d, BPE, tokenizers.PATTERN, ["doc_id"]),
    "decontaminate": lambda d: decontaminate.decontamination_digest(d, d.selectExpr("doc_id as item_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(frame, name):
    assert OPERATORS[name](frame([])).collect() == []


def test_classifiers_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    docs = frame([(1, None), (2, "some text")]).select("doc_id", "text")
    assert {r["score"] for r in classifiers.fit_toxicity(none).score(docs).collect()} == {0.5}
    assert {r["score"] for r in classifiers.fit_quality(none).score(docs).collect()} == {0.5}
