"""The pipeline on a small table, stage by stage, against brute force; and the registered queries."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import UPPER, WORD, brute_components


def test_pipeline(spark, docs, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    cur = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, d)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{k}")
        cur = spark.read.parquet(f"{d}/{k}")
        steps[name] = [tuple(r) for r in cur.collect()]
    start = [tuple(r) for r in docs.collect()]
    first = steps["language_id"]
    assert {r[0] for r in start if not re.search(r"[^\W\d_]", r[1] or "")}.isdisjoint({r[0] for r in first})
    texts = {(r[1] or "").translate(UPPER) for r in first}
    second = steps["exact_dedup"]
    assert len(second) == len(texts) and {(r[1] or "").translate(UPPER) for r in second} == texts
    third = steps["near_dedup"]
    groups = {low if low is not None else ("none", i) for i, _, low in brute_components(second, 5, 80)}
    assert len(third) == len(groups)
    fourth = Counter(steps["mixing"])
    assert set(fourth) <= set(third) and max(fourth.values()) <= 3
    words = lambda rows: sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert abs(words(steps["mixing"]) - words(third)) <= 4 * max(len(WORD.findall(r[1] or "")) for r in third)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert Counter((r[0], r[1]) for r in steps["sentencepiece"]) == Counter((r[0], len(lib.encode(r[1] or "", add_bos=True, add_eos=True))) for r in steps["mixing"])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == Counter(steps["sentencepiece"])


def test_pipeline_on_empty_and_unlabelled_tables(spark, docs, none, clashing, tmp_path):
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    few = clashing.filter("doc_id in (0, 1, 2, 300, 301, 303, 402, 403)").withColumn("lang", F.lit(None).cast("string"))
    few.write.parquet(f"{tmp_path}/few/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/few/documents.parquet")
    kept = corpus_pipeline.language_stage(spark, table, f"{tmp_path}/few")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 402, 403] and kept.columns == clashing.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, f"{tmp_path}/few")
        assert table.columns == clashing.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/few").collect()}
    assert ids <= {0, 1, 2, 403} and 403 in ids


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_split_is_crc32(spark):
    from ledgerloom.llm.labelled import remainder

    rows = spark.range(0, 50).select("id", remainder(F.col("id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in rows) and np.unique([r.m for r in rows]).size > 1
