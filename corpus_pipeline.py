"""The corpus pipeline: stages that each take the documents kept so far and return the next ones, the last one tokens.

Every stage is written as Parquet and read again before the next, in ``run`` as in the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probanda.llm import common, encoding, jaccard, mixing, toxicity
from probanda.llm.queries import _vocabulary


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores more as make it no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, does not call toxic.

    Null and empty texts have no words, so they stay, as do rows without an id. Repeated rows are judged alike. Without labels of both
    kinds nothing is called toxic. All columns are kept whatever their names; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, name = toxicity.fit(docs, labels), _free(docs, "score")
    return toxicity.score(docs, model, keep=tuple(docs.columns), out=name).where(F.col(f"`{name}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    A row whose text is linked to one under a smaller id goes. Of rows that share an id and are linked with one another that with the
    first text in byte order stays (and of rows equal in id and text one); rows that share an id but aren't linked all stay. Texts
    without words are no copies of one another, so they stay, as do rows without an id. All columns are kept whatever their names; an
    empty table gives an empty one.
    """
    return jaccard.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for.

    Null and empty texts have no words and follow their source's rate; null is a source of its own, last in order. Rows that repeat an
    id are drawn alike if they share a source. All columns are kept whatever their names; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids, the tokens, of every document of the mix: one row a copy. Null and empty texts have no tokens;
    other columns are left out; an empty table gives an empty one."""
    return encoding.encode(docs, _vocabulary(), keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL cannot express the classifier, the tokenizer or, at this size, the join; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the mix of the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.staged(docs, f"pipeline-{name}")
            common.discard(before)
    return docs
