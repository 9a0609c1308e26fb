"""From raw documents to token ids in five stages, each over all rows that the one before has kept."""

from __future__ import annotations

import functools
import operator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import bpe, decontamination, near_dups, pii, quality
from gridloom.llm.common import materialize, table
from gridloom.llm.queries import crc_is

#: Rejected texts up to this number are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Names of the columns that a stage adds for itself: two hashes of the text.
HASHES = ["_hash_1", "_hash_2"]


def _hashed(docs: DataFrame) -> DataFrame:
    """Rows of docs with 128 bits of hashes of their texts, so that each is judged by its own text whatever its id is."""
    return docs.withColumns({"_hash_1": F.xxhash64(F.lit(1), "text"), "_hash_2": F.xxhash64("text")})


def _without(rows: DataFrame, rejected: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose columns `by` are not among those rejected; nulls are equal."""
    keys = materialize(rejected.select(*[F.col(c).alias(f"_no{c}") for c in by]).distinct())
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_no{c}")) for c in by])
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. A null text is judged as an empty one; each row by its own text, with or without an id."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), crc_is(3, 1))
    rows = _hashed(docs)
    judged = quality.score_quality(rows, model, key="_hash_1", carry=["_hash_2"])
    return _without(rows, judged.where("predicted = 0").select(F.col("doc_id").alias("_hash_1"), "_hash_2"), HASHES).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id (rows without an id come last).

    Of texts without words one stays for each id and text, and all that have no id. Of
    rows of one id and one text one stays, the first by all columns. Texts go by a hash of
    64 bits; where two texts share it, which a count of another 64 bits shows, rows get
    numbers instead.
    """
    rows = _hashed(docs)
    clash = rows.groupBy("_hash_1").agg((F.min("_hash_2") != F.max("_hash_2")).alias("clash")).where("clash")
    if clash.limit(1).count():
        rows = materialize(docs.withColumns({"_hash_1": F.monotonically_increasing_id(), "_hash_2": F.lit(0).cast("long")}))
    named = rows.select(F.col("_hash_1").alias("key"), "text", "doc_id", "_hash_1", "_hash_2").withColumnRenamed("doc_id", "own")
    judged = near_dups.near_duplicates(named, key="key", carry=["own", *HASHES])
    group = F.when(F.col("n_shingles") > 0, F.struct("component_id")).alias("group")
    keys = materialize(judged.groupBy(group, F.col("own").alias("doc_id"), *HASHES).agg(F.count(F.lit(1)).alias("times")))
    least = keys.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *HASHES)).alias("least"))
    kept = materialize(least.select(F.col("least.doc_id").alias("doc_id"), *[F.col(f"least.{h}").alias(h) for h in HASHES]))
    by = ["doc_id", *HASHES]
    left = _without(rows, _without(keys.where("group is not null"), kept, by), by)
    again = keys.where("times > 1 and (group is not null or doc_id is not null)")
    if not again.limit(1).count():
        return left.select(docs.columns)
    again = materialize(again.select(*[F.col(c).alias(f"_no{c}") for c in by]))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_no{c}")) for c in by])
    first = Window.partitionBy(*by).orderBy(F.xxhash64(*docs.columns), *[c for c in docs.columns if c != "text"])
    one = left.join(again, same, "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return left.join(again, same, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts stay, as rows without an id do where their text is clean."""
    rows = _hashed(docs)
    judged = decontamination.contamination(rows.select(F.col("_hash_1").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), with_text_hash=True)
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_hash_1"), F.col("of_text").alias("_hash_2"))
    return _without(rows, bad, HASHES).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars, where there is one, follows the text. Null texts stay null."""
    cleaned = pii.redact(docs, pii.fit_pii(docs))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return cleaned.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, ids."""
    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
