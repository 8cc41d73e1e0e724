"""A corpus pipeline of five stages; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import language_id, line_dedup, mixing, sentencepiece_bpe, simhash
from strataloom.llm.common import keep, table
from strataloom.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that score below nearly all pieces of their length of the learned languages, go."""
    pred, score, familiar = _free("lang_pred", docs), _free("score", docs), _free("familiar", docs)
    found = language_id.identify(docs, carry=docs.columns, pred_col=pred, score_col=score, familiar_col=familiar)
    return found.where(F.col(familiar)).drop(pred, score, familiar)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that held nothing else; ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs).where("not had_text or has_lines or n_lines = n_kept")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    columns |= {"text": F.col("text"), "n_chars": F.when(F.col("n_lines") == F.col("n_kept"), F.col("row.n_chars")).otherwise(F.length("text"))}
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs, words=3, bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.tokenise(docs, public_tokenizers.path(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("line_dedup", keep_first_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

ORACLE_SQL = None


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
