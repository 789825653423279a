"""The training-data pipeline over ``documents``: named stages, each written and read again.

Every stage but the last returns the columns of its input; other columns ride along under any name.
A row without a document id passes the stages that judge documents by id.
"""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from postflow.llm import bpe, decontaminate, langid, minhash, suffixes
from postflow.session import shared_dir


def language(spark, docs, folder):
    """Operator 9: documents judged ``und`` go, which are those that are null or without a letter."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # so that no column's name can clash
    plain, column = docs.toDF(*inner), dict(zip(names, inner))
    profiles = langid.learn(plain, column["text"], column["lang"], seed=column["doc_id"])
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))  # without a language nothing else can be rejected
    found = langid.predict(plain, profiles, column["doc_id"], column["text"], keep=tuple(inner))
    return found.filter(F.col("lang_pred") != "und").select(*[F.col(c).alias(name) for name, c in column.items()])


def near_dedup(spark, docs, folder):
    """Operator 4: of each group of near copies one document stays, that of the smallest id and, among those, of the smallest
    mark; of rows that repeat an id and a text one stays, whatever their other columns."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # so that no column's name can clash
    column = dict(zip(names, inner))
    plain = docs.toDF(*inner)
    stay = minhash.near_duplicates(plain, column["doc_id"], column["text"]).filter("kept and doc_id is not null")
    stay = stay.select("doc_id", "mark").distinct()
    marked = plain.withColumns({"doc_id": F.col(column["doc_id"]).cast("long"), "mark": F.xxhash64(F.coalesce(column["text"], F.lit("")))})
    kept = marked.join(stay, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])  # the join has put them together
    alone = marked.filter("doc_id is null")
    return kept.select(*inner).unionByName(alone.select(*inner)).toDF(*names)


def suffix_dedup(spark, docs, folder):
    """Operator 7: bytes of strings that start earlier go; parts of characters that are left go too."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # so that no column's name can clash
    column = dict(zip(names, inner))
    own = column["text"]
    plain = docs.toDF(*inner).withColumn("none", F.col(own).isNull())
    ride = [c for c in inner if c != own] + ["none"]  # the text itself travels once
    found = suffixes.dedup_bytes(plain, column["doc_id"], own, keep=tuple(ride))
    rest = {c: F.col("rest")[f"c{k}"] for k, c in enumerate(ride)}
    same = F.col("n_removed") == 0
    text = F.when(~rest["none"], F.when(same, F.col("kept").cast("string")).otherwise(F.col("whole")))
    columns = {name: text if c == own else rest[c] for name, c in column.items()}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(same, columns["n_chars"]).otherwise(F.length(text)).cast("long")
    return found.select(*[value.alias(name) for name, value in columns.items()])


def decontamination(spark, docs, folder):
    """Operator 5: documents with a twentieth of their words in benchmark passages go."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    gone = decontaminate.contaminated_docs(docs, items).filter("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark, docs, folder):
    """Operator 10: the number and a digest of every document's ids, and a digest of what they decode to."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL can express neither the language profiles nor the merges.
ORACLE_SQL = None


#: Bytes of a row group of a stage's files, which a task holds in memory as it writes whole documents.
ROW_GROUP = 32 << 20


def run(spark, folder):
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus_pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.option("parquet.block.size", ROW_GROUP).parquet(path)
        docs = spark.read.parquet(path)
    return docs
