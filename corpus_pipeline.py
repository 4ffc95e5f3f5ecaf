"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece encoding.

Every stage works on all that the one before kept, written as Parquet in the shared folder and read again; what a stage
writes on its way is deleted when it ends.

Null texts and texts without letters go in the first stage, whatever lang and source say; where no document has a known
lang, all with letters stay. A null doc_id is smaller than any in exact dedup and larger than any in near dedup. Of rows that
repeat doc_id and text one stays. Documents of a null source are a source of their own. The mix takes a document several times, or
not at all; so ids repeat from there on. An empty table gives an empty result. Extra columns, whatever their names, are kept up to
the last stage and play no part.
"""

import public_tokenizers

from ledgerloom.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from ledgerloom.llm.common import scratch


def language_stage(spark, docs, sf_dir):
    """Documents without a language go (null or without letters)."""
    return language_id.accept(docs, language_id.train(docs))


def exact_stage(spark, docs, sf_dir):
    """Of texts equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of documents linked at similarity 0.8 (five-word shingles), the one with the smallest doc_id stays."""
    return near_dedup.dedup(docs, size=5, percent=80)


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the mix takes them, in order of training position."""
    return mixing.copies(docs)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("sentencepiece", encoding_stage)]

#: No SQL: language profiles, MinHash and SentencePiece have none. The tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage writes on its way goes as well
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
