"""A corpus from raw documents to packed training sequences, in five stages, each written before the next one reads it.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns
of documents, in which their decisions have taken effect.

Odd rows: a null text, and one without a letter, goes at the first stage.  A null doc_id stays, and counts as smaller than
all others; of rows that repeat each other, exact_stage() keeps one.  Ties go to the language first in the alphabet, the
largest doc_id (exact copies) and the smallest (near copies, repeats).  Further columns are carried along, whatever their
names.  An empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runweave.llm import exact_dedup, langid, minhash, packing, substring_dedup
from runweave.llm.common import documents, drop_table, stage_table, staged_tables
from runweave.llm.token_ids import vocabulary_path

REPEAT_WORDS = 50
SEEN = 100_000  # units in each generation that the last stage's workers remember, beside JVMs that the stages before have filled


def language_stage(spark, docs, sf_dir):
    """Documents without a letter, or whose language is a near tie, go; fitted to the documents that have a language."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_stage(spark, docs, sf_dir):
    """Of texts equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near_stage(spark, docs, sf_dir):
    """Of each component of texts with five-word shingle sets similar by 0.8, the one with the smallest doc_id stays."""
    return minhash.keep_representatives(docs, k=5, threshold=80)


def substring_stage(spark, docs, sf_dir):
    """Words under REPEAT_WORDS-word windows that a smaller doc_id has too go; n_chars follows."""
    out = substring_dedup.strip_repeats(docs, REPEAT_WORDS)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    """Pieces of 2048-token sequences with the corpus's mixture of sources."""
    return packing.pack_documents(docs, vocabulary_path(), 1, seen=SEEN)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # compression, MinHash and the tokenizer have no SQL form; tests hold run() against a brute-force version


def run(spark, sf_dir):
    """All stages over documents; what a stage has written for itself, and its input, goes once its result is written."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with staged_tables() as made:
            docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for table in (*before, *made[:-1]):
            drop_table(table)
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
