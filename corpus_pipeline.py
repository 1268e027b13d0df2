"""Corpus cleaning: language ID, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from inkspan.llm import bagminhash, bpe, langid, pii, positional
from inkspan.llm.queries import table, tokenizer_path
from inkspan.session import shared_folder


def known_language(spark, docs, sf_dir):
    """Documents without letters, or with no language clearly ahead, go."""
    return langid.keep_known(docs, langid.fit(docs))


def one_of_each(spark, docs, sf_dir):
    """Of every group of near copies the document with the smallest doc_id stays."""
    return bagminhash.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return positional.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark, docs, sf_dir):
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, n_tokens, digests of ids and decoded text, and the ids."""
    return bpe.tokenise(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("near_copies", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", redacted),
    ("tokens", tokens),
]

#: Learned filters, hashed signatures and byte-pair merges are no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; every stage is written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
