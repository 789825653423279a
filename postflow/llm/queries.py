"""The registered queries of the training-data operators; SQL for those that have it is in ``oracle``."""

import uuid

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from postflow.llm import (
    bpe, chat, covertree, decontaminate, langid, lm, minhash, nsbounds, suffixes, tokenfiles, trees, trie, urls,
)
from postflow.llm.oracle import ORACLE as ORACLE
from postflow.session import materialise, shared_dir

#: Fixed by the query's contract.
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(doc_id, folds):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op1_substring_dedup(spark, folder):
    """Words of every document without those in windows of 35 that start anywhere else too."""
    return trees.digest(trees.dedup_words(_table(spark, folder, "documents")))


def op2_token_files(spark, folder):
    """Token ids of every document, written as files and read back."""
    docs = _table(spark, folder, "documents")
    coded = materialise(tokenfiles.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2), "token-ids")
    path = f"{shared_dir(spark)}/postflow/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_files(coded, path, 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tokenfiles.checksums(tokenfiles.read_files(spark, path))


def op3_lm_score(spark, folder):
    """The log probability of every document by a model of those outside the held-out fold."""
    docs = _table(spark, folder, "documents")
    return lm.score(docs, _fold(docs.doc_id, 7) != 2)


def op4_near_duplicates(spark, folder):
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op5_contamination(spark, folder):
    """How many words of every document lie in benchmark passages."""
    return decontaminate.contaminated_docs(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_embedding_dedup(spark, folder):
    """The links and the component of every vector."""
    return covertree.near_vectors(_table(spark, folder, "embeddings"))


def op7_suffix_dedup(spark, folder):
    """Bytes of every document without those in strings of 100 that start earlier."""
    return suffixes.digest(suffixes.dedup_bytes(_table(spark, folder, "documents")))


def op8_urls(spark, folder):
    """The verdict on every page by rules, else by the reputation of its host."""
    labels = _table(spark, folder, "labels")
    bad = labels.select(
        F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    )
    return urls.filter_urls(_table(spark, folder, "pages"), bad, URL_RULES).drop("bad_bound")


def language_profiles(docs):
    """Learned from the documents outside the held-out fold."""
    train = docs.filter(F.coalesce(_fold(F.col("doc_id"), 4) != 2, F.lit(True)))
    return langid.learn(train)


def op9_language(spark, folder):
    """The language of every document, learned outside the held-out fold."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), language_profiles(docs))
    held_out = F.coalesce(_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op10_bpe(spark, folder):
    """The token ids of every document and what they decode to."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_chat(spark, folder):
    """Every conversation as a chain of replies, formatted and read back; turns of equal number by role and text."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    chain = rows.unionByName(more).withColumn("place", place).withColumn("before", F.col("place") - 1)
    return chat.digest(chat.format_trees(chain, "conv_id", "place", "before"))


def rebuilt_turns(conversations):
    """(conv_id, place, code) of conversations that begin with turns of the first one of their hundred."""
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", trie.turn_code(F.col("role"), F.col("text")).alias("code"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "code"))
    placed = materialise(turns.select("conv_id", place.alias("place"), "code"), "turns")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")  # 5 at most
    own = placed.filter(F.col("place") > taken).select("conv_id", (F.col("place") + 5).alias("place"), "code")
    heads = placed.filter((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5)).withColumnRenamed("conv_id", "head")
    convs = placed.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("head"), taken.alias("taken"))
    lent = convs.join(heads, "head").filter("place <= taken").select("conv_id", "place", "code")
    return lent.unionByName(own), convs.select("conv_id")


def op12_prefix_trie(spark, folder):
    """The trie of all rebuilt conversations; turns of equal number by their digests."""
    return trie.prefix_trie(*rebuilt_turns(_table(spark, folder, "conversations")))


def op13_centroid_clusters(spark, folder):
    """40 clusters of all vectors after 5 rounds."""
    return nsbounds.centroid_clusters(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_lm_score": op3_lm_score,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_contamination": op5_contamination,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_urls": op8_urls,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_chat": op11_chat,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_centroid_clusters": op13_centroid_clusters,
}
