"""The queries opN_<name>: each applies its operator, with production parameters, to the whole of its table."""

import public_tokenizers

from ledgerloom.llm import exact_dedup, language_id, mixing, near_dedup, pieces, quality_model, rules, token_count, token_files, toxicity


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.plan(_docs(spark, sf_dir))


def op2_quality_classifier(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return quality_model.score(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_sentencepiece(spark, sf_dir):
    return pieces.digests(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.classes(_docs(spark, sf_dir))


def op5_minhash_near_dedup(spark, sf_dir):
    return near_dedup.classes(_docs(spark, sf_dir), size=4, percent=80)


def op6_token_files(spark, sf_dir):
    return token_files.write_and_read(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_rules(spark, sf_dir):
    out = rules.apply(rules.ledger(_docs(spark, sf_dir)))
    base = out["failed"].bitwiseAND(rules.mask("base")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op8_token_counts(spark, sf_dir):
    return token_count.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def op10_toxicity(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_sentencepiece, op4_exact_dedup, op5_minhash_near_dedup, op6_token_files, op7_quality_rules, op8_token_counts, op9_language_id, op10_toxicity)}
ORACLES = {"op1_mixing": mixing.SQL, "op4_exact_dedup": exact_dedup.SQL, "op7_quality_rules": rules.SQL}
