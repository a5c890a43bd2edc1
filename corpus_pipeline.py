"""A corpus pipeline: quality, boilerplate lines, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, with ``n_chars`` of the text as it then is. Stages are written as
Parquet and reread in between. Null texts count as empty throughout, null ids and sources stay, rows that
repeat are rows of their own until near copies go (rows of one id are then one document: all of them
stay or go), and other columns are left out; see each operator for the rest of its edge cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import quality
from glyphmill.llm.bpe import bpe_encode, default_tokenizer
from glyphmill.llm.common import SPACE, WORD, materialize, read, ship, text_of
from glyphmill.llm.line_dedup import line_dedup
from glyphmill.llm.mixing import mix
from glyphmill.llm.near_dedup import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A source's line is boilerplate if at least so many of its documents hold it, and more than this share of them.
#: The ratio lies in the gap of the curve of line frequencies: on sf0.1 one line is in 8.6 to 13.2% of every source, all others are in 4.8% of one at most.
LINE_DOCS, LINE_RATIO = 10, 0.07


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length(text_of()).cast("bigint")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more; it learns from the labelled ones (a bounded sample)."""
    ship(spark)
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return _documents(quality.score(docs.select(*COLUMNS), model, out_col="_score").where(F.col("_score") >= quality.THRESHOLD))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, ratio: float = LINE_RATIO) -> DataFrame:
    """Every document, without the boilerplate lines of its source."""
    ship(spark)
    return _documents(line_dedup(docs.select(*COLUMNS), "doc_id", "text", "source", ratio, LINE_DOCS))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one with the smallest id."""
    ship(spark)
    gone = near_dedup(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it is."""
    between = F.split(text, WORD)
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    return F.array_join(F.zip_with(F.slice(between, F.lit(1), n), F.slice(words, F.lit(1), n), lambda a, w: F.concat(a, w)), "")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document whole, and one with its first words where it takes a part.

    Blocks are taken from the start of a source's line, so what is taken of a document in part are its first words.
    """
    ship(spark)
    mixed = mix(docs.select(*COLUMNS)).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    times = mixed.withColumns({"_part": part, "_copy": F.explode(F.sequence(F.lit(1), whole + F.when(part > 0, 1).otherwise(0)))}).withColumn("_whole", whole)
    cut = first_words(text_of(), F.greatest(F.col("_part"), F.lit(1)))
    return _documents(times.withColumn("text", F.when(F.col("_copy") <= F.col("_whole"), F.col("text")).otherwise(cut)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    ship(spark)
    coded = bpe_encode(docs, default_tokenizer(), decoded_col="_decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.col("_decoded") == text_of()).alias("exact"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near),
    ("source mixing", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
