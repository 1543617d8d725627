"""From documents to training sequences: identify, drop repeated lines, drop near copies, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; ``run`` writes every
stage's result to the shared folder before the next one reads it, and then deletes what it was made from. All but the
last return the columns of ``documents``, and any others that they are given. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import langid, linededup, mixing, packing, queries, simhash
from brindle.llm.common import discard, documents, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others carry the predicted language.

    A text that is null, empty or without a letter is rejected. Rows that repeat are judged alike and stay as often as given.
    """
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are one edit away from it, go, and documents that lose all they have.

    A null text stays null and an empty one empty. Rows that repeat id and text are one document and stay as often as given;
    of documents with equal texts the one with the smallest id keeps the lines, a missing id coming first.
    """
    done = linededup.dedup_lines(docs).where("n_removed = 0 OR trim(text) <> ''")
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies are what the SimHash operator's contract links: fingerprints of three-word shingles at three or fewer differing
    bits, and whatever such links reach. Null and wordless texts are one group; of rows that repeat id and text one stays.
    """
    return simhash.keep_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of the budget, a row for each epoch that uses a document.

    The budget is three fifths of all tokens: weights can only be met if some leaves give less than they have, and with two
    epochs a leaf of up to twice its share of the supply can. Null and wordless texts have no tokens and go;
    rows that repeat id and text are one document and stay as often as given, for each epoch.
    """
    return mixing.mix(docs, queries.domain_of(), queries.WEIGHTS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text is the end token alone. Rows that repeat, a document used in two epochs among them, are packed as often
    as given. Other columns are left out.
    """
    return packing.pack(docs, **queries.tokenizer_files())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("sequence_packing", sequence_packing)]

#: Character models and tokenisation are beyond SQL; the tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
