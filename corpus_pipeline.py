"""Corpus pipeline: documents in, deduplicated, decontaminated and tokenised
documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the rows that stay, with the columns of ``documents`` (the last
one adds the tokens).  ``run`` writes each stage's result as Parquet below the
session's checkpoint folder and gives it to the next stage.

* language_id drops documents without a letter, and those whose best language
  scores below MIN_LANGUAGE_SCORE (no language of the corpus fits).
* line_dedup cuts cross-site boilerplate lines wherever they stand; every
  document stays, and one that has no other line is left whole.
* near_dedup keeps one row of each group of near-duplicates (five-word shingles,
  similarity 0.8): that with the smallest id.  Several texts of one id are
  judged each by itself, the second and further ones as if their ids were larger
  than all others; of rows with equal id and text (null: empty) one stays.
* decontaminate drops rows whose text holds a benchmark item or a passage of
  one.
* bpe adds n_tokens, ids_sha256, decoded_sha256 and ids, the token ids.

Edge cases: rows with null ids pass through near_dedup, as nothing names
them; null texts are dropped by language_id; an empty table gives an empty
result; extra columns are kept.

Whole texts go to Python in Arrow batches of BATCH_ROWS rows, unless the session
names a size: at Spark's 10,000 a batch of ordinary documents takes tens of MB,
several times over, in the executor and in each worker.  A stage sets this for
the session that its rows are written in; ``run`` restores the session's setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemarts.llm import bpe, decontam, langid, line_dedup, near_dup
from valuemarts.llm.common import Scratch, split_of
from valuemarts.llm.queries import TOKENIZER, table

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
MIN_LANGUAGE_SCORE = 0.3
SHINGLE, SIMILARITY = 5, 80


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = langid.fit(docs, split_of("doc_id", 4) != 2)
    scored = langid.predict(docs, model, keep=tuple(docs.columns), prefix="__")
    return scored.where((F.col("__lang_pred") != langid.UND) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*_names(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs).select(*_names(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    with Scratch(spark, "near-dedup") as tmp:
        keyed, repeats = _row_keys(docs, tmp)
        groups = near_dup.groups(keyed, shingle=SHINGLE, threshold=SIMILARITY, key="__key")
        gone = tmp.write(groups.where("not kept").select(F.col("id").alias("__id")).distinct(), "gone", keep=True)
    kept = keyed.join(gone, F.col("__key") == F.col("__id"), "left_anti")
    if not repeats:
        return kept.select(*_names(docs))
    # equal rows share a key: one of them stays
    again = keyed.where("__key is not null").groupBy("__key").count().where("count > 1").select(F.col("__key").alias("__id"))
    once = kept.join(again, F.col("__key") == F.col("__id"), "left_anti").select(*_names(docs))
    row = F.struct(*_names(docs))
    several = (kept.join(again, F.col("__key") == F.col("__id"), "left_semi").groupBy("__key")
               .agg(F.min_by(row, F.xxhash64(*_names(docs))).alias("__r")).select("__r.*"))
    return once.unionByName(several)


def _row_keys(docs: DataFrame, tmp: Scratch) -> tuple[DataFrame, bool]:
    """``docs`` with __key: the document's id, or a number beyond all ids for
    the second, third ... text of an id, so that each text is judged by itself;
    and whether ids repeat.  Rows with a null id have no key."""
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id")
    if not repeated.head(1):
        return docs.withColumn("__key", F.col("doc_id").cast("long")), False
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    texts = docs.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi").select(F.col("doc_id").alias("__id"), digest.alias("__digest")).distinct()
    more = texts.join(texts.groupBy("__id").agg(F.min("__digest").alias("__least")), "__id").where("__digest <> __least")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
    beyond = F.lit(high + 1) + F.monotonically_increasing_id() if high < 1 << 62 else F.lit(low - 1) - F.monotonically_increasing_id()
    more = tmp.write(more.select("__id", "__digest", beyond.alias("__more")), "row-keys", keep=True)
    keyed = docs.withColumn("__text", digest).join(more, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left")
    return keyed.select(*_names(docs), F.coalesce("__more", F.col("doc_id").cast("long")).alias("__key")), True


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    # a row's text alone decides, so rows with null or repeated ids stand for themselves
    keyed = docs.withColumn("__text_key", F.sha2(F.col("text").cast("string"), 256))
    hits = decontam.matches(keyed, table(spark, sf_dir, "benchmark"), part_words=decontam.PASSAGE_WORDS, key="__text_key")
    hits = hits.select(F.col("id").alias("__hit")).distinct()
    return keyed.join(hits, F.col("__text_key") == F.col("__hit"), "left_anti").select(*_names(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.encode_texts(docs, TOKENIZER, keep=tuple(docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", tokens),
]

#: the language model, the odd sketches and the tokenizer have no SQL form;
#: tests/llm/test_pipeline.py holds the result against a brute-force version
ORACLE_SQL = None


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, size = table(spark, sf_dir, "documents"), spark.conf.get(ARROW_ROWS, None)
    try:
        with Scratch(spark, "pipeline") as tmp:
            for k, (name, stage) in enumerate(STAGES):
                docs = tmp.write(stage(spark, docs, sf_dir), name, keep=k == len(STAGES) - 1)
    finally:
        if size is None:
            spark.conf.unset(ARROW_ROWS)
    return docs
