"""A training-data pipeline over documents, of five of the operators in ``tideglass.llm``.

Each stage takes (spark, docs, folder of the tables) and returns what it keeps with the columns of
documents; the last returns token digests. The stages' results are written as Parquet, or to the checkpoint folder by ``run``, before
the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import decontaminate, jaccard, secrets, tokens, toxicity
from tideglass.llm.registry import remainder, vocabulary
from tideglass.session import cut, fresh, prepare, quoted, table

#: Ids that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def _packed(docs: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """docs with only the columns that a stage looks at, and one that holds all others, whatever they are called and of whatever type; and the name of that one."""
    row, none = fresh(docs, "_row", "_none")
    others = F.struct(F.lit(None).cast("int").alias(none), *(F.col(quoted(c)) for c in docs.columns if c not in names))
    return docs.select(*names, others.alias(row)), row


def _unpacked(df: DataFrame, row: str, docs: DataFrame, *names: str, **new: Column) -> DataFrame:
    """The columns of docs again."""
    return df.select(*(new.get(c, F.col(c) if c in names else F.col(row)[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that are predicted toxic. Learns from labels of the documents that are here.

    Null and empty texts are scored as texts without words, which stay as a rule; repeated rows stay or go together; an empty table stays empty.
    """
    prepare(spark)
    slim, row = _packed(docs, "doc_id", "text")
    scored = toxicity.score_texts(slim, table(spark, folder, "labels"), remainder(5) == 0)
    return _unpacked(scored.filter("predicted = 0"), row, docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of near copies: of the text that stands for it and with the smallest doc_id, of several such rows the smallest as JSON.

    Rows without words are nobody's copies; of those with the same id and text one stays, those without an id all stay.
    """
    prepare(spark)
    slim, row = _packed(docs, "doc_id", "text")
    head, key, n = fresh(slim, "_head", "_key", "_n")
    classed = jaccard.near_duplicates(slim, head=head)
    kept = classed.filter(F.col(head).isNull() | (F.col(head) & F.col("doc_id").eqNullSafe(F.col("class_id"))))
    named = F.col(head).isNotNull() | F.col("doc_id").isNotNull()
    same = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "text"), F.lit("-"))), 256)
    kept = kept.select(F.when(named, same).alias(key), "doc_id", "text", row)
    again = cut(kept.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(key))
    many = again.count()
    if not many:
        return _unpacked(kept, row, docs, "doc_id", "text")
    again = F.broadcast(again) if many <= BROADCAST_IDS else again
    # (rows are ordered as text, as some types have no order)
    once = kept.join(again, key, "left_semi").groupBy(key).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min_by(row, F.to_json(row)).alias(row))
    return _unpacked(kept.join(again, key, "left_anti").unionByName(once), row, docs, "doc_id", "text")


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold a copy of a test item. Null and empty texts hold none and stay; repeated rows stay or go together."""
    prepare(spark)
    slim, row = _packed(docs, "text")
    found = decontaminate.with_leaks(slim, table(spark, folder, "benchmark"))
    return _unpacked(found.filter(F.size("leaks") == 0), row, docs, "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; n_chars follows a text that changes. Null and empty texts stay as they are."""
    prepare(spark)
    slim, row = _packed(docs, "text", "source")
    (before,) = fresh(slim, "_before")
    clean = secrets.redact(slim.withColumn(before, F.col("text")))
    n_chars = F.when(~F.col("text").eqNullSafe(F.col(before)), F.length("text").cast("long")).otherwise(F.col(row)["n_chars"])
    return _unpacked(clean, row, docs, "text", "source", n_chars=n_chars)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Number of tokens and the digests of ids and of decoded text of each document. Null and empty texts have no tokens; repeated rows come each for themselves."""
    prepare(spark)
    return tokens.encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: A trained kernel machine and a forest decide; SQL can't express them. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents: doc_id, lang, source, n_tokens and the digests of what is left. Null and empty texts pass all stages, repeated rows leave one, an empty table gives no rows, further columns of any name and type are carried along."""
    docs = table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
