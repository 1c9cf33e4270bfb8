"""A training corpus from raw documents: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept. All but the last return the columns of documents.

Defined cases, for all stages: an empty table gives an empty one. A null text counts as an
empty one; a null id is an id like any other. Texts are read whole. Other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import discard, written
from tallyvane.llm.decontaminate import clean_documents
from tallyvane.llm.mixing import mixed, posteriors, rates, smoothed_targets
from tallyvane.llm.quality import kept
from tallyvane.llm.queries import table, word_vocabulary
from tallyvane.llm.simhash import one_per_group
from tallyvane.llm.token_output import read_tokens, write_tokens

#: Languages are mixed in proportion to their expected tokens to this power.
SMOOTHING = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, repeated rows each; what a null or empty text is worth is learnt from all documents."""
    return kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: of the smallest id, then text digest. Wordless documents are one group."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item. Wordless documents hold none; an empty benchmark drops none."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their languages.

    The rates' floor is 1, so no document is lost; the budget starts where no language has
    to shrink, and is raised until the targets are met. Without labelled documents, or tokens, every document stays once.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    found, domains = posteriors(docs, labelled)
    now = smoothed_targets(found, domains, 1.0)
    targets = smoothed_targets(found, domains, SMOOTHING)
    total = sum(targets.values())
    budget = max((now[d] * total / targets[d] for d in domains if targets[d]), default=None)
    return mixed(docs, rates(found, domains, targets, budget, floor=1.0, raise_budget=True))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in patched frame-of-reference files, and what they hold per document, copies in any order among themselves."""
    return read_tokens(spark, write_tokens(docs, word_vocabulary()))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token-ID output", token_files),
]

#: Fitted scorers and a byte-level tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
