"""The corpus pipeline: five stages, each an llm operator over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``,
but for the last, which returns packed pieces. ``run`` chains the stages over
``documents``; each result is written as Parquet to the shared folder and reread;
the folder of a stage goes once the next one is written (the last one's input stays,
as the result is computed from it).

Nulls: null texts count as empty and stay null in the table; null ids are kept.
An empty table gives no pieces. Extra columns pass through to the last stage.
Ties: of linked documents the smallest id stays; documents of equal mixing keys
are ordered by id and size. The mixing stage writes its rows in training order,
and packing goes by it: sequence ids rise with the training position.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import mixing, ngram_join, packing, secret_scan, toxicity
from millrace.llm.queries import tokenizer_path
from millrace.session import shared_dir, table


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents of the input."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id stays; one row.

    Rows are told apart by two 64-bit digests of all their columns, so it does
    not matter whether ids repeat or are null (null ids come last). Rows without
    words are linked with nothing and stay; rows equal in all columns count as one.
    """
    digests = [f"{max(docs.columns, key=len)}_digest{i}" for i in range(2)]  # longer than any name, so none clashes
    columns = [docs[f"`{c}`"] for c in docs.columns]
    told = [*columns, *(c.isNull() for c in columns)]
    rows = docs.select(*columns, *(F.xxhash64(F.lit(i), *told).alias(d) for i, d in enumerate(digests)))
    found = ngram_join.grouped(rows, carry=tuple(digests))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *digests)).alias("first")
    chosen = found.where("group_key IS NOT NULL").groupBy("group_key").agg(first).select("first.*")
    chosen = chosen.select(*digests).union(found.where("group_key IS NULL").select(*digests))
    return rows.join(chosen, digests, "left_semi").dropDuplicates(digests).select(*docs.columns)


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, as often as it takes them."""
    return mixing.mixed_documents(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` in the order in which its files were written, spread over partitions by range.

    Spark deals files to tasks by their size; the number in a file's name and a
    row's number in its file give the order in which a sorted table was written.
    Rows that come from no file keep the order of their partitions.
    """
    try:
        file = docs.metadataColumn("_metadata")
        place = [F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).try_cast("long"), file["file_name"], file["row_index"]]
        placed = docs.select("*", F.struct(*(c.alias(f"p{i}") for i, c in enumerate(place))).alias("_place"))
    except AnalysisException:
        placed = docs.withColumn("_place", F.struct(F.monotonically_increasing_id().alias("p0")))
    order = [F.col(f"_place.{c}") for c in placed.schema["_place"].dataType.names]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, packed into sequences of 2048; sequence ids rise with the training order."""
    return packing.pack(in_order(docs.select("doc_id", "text")), tokenizer_path("word_bpe_49k.json"))


def remove(spark, path: str) -> None:
    """Removes a folder of this run, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage's classifier cannot be written in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number > 1:
                remove(spark, f"{folder}/{number - 1}")
    return docs
