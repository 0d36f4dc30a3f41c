"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each
result as Parquet into the shared folder and reads it again. All but the last stage return the columns
of documents; a stage that changes a text also counts its characters anew.

1. quality classifier: rows that the factorisation machine rejects go;
2. n-gram Jaccard join: of each component of linked documents the one with the smallest id stays;
3. suffix-array dedup: bytes that repeat a 50-byte string of a smaller document go, and texts left empty;
4. benchmark decontamination: spans of benchmark windows go, and documents mostly made of them;
5. SentencePiece: ids of every text, with digests of the ids and of the decoded text.

Rows with a null doc_id pass through 2 and 3 unchanged, being nobody's copy. Rows that repeat an id stay
or go together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmesh.llm import decontamination, jaccard_join, quality_model, sentencepiece_bpe, suffix_dedup
from reportmesh.llm.frames import held_out, read
from reportmesh.session import write_stage

#: A document goes when more than this share of its words, in percent, is a benchmark's.
MAX_HIT_PERCENT = 50


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name of theirs meets an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("other_columns"))


def _unpacked(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the new text."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select(*[own.get(c, F.col("other_columns").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality model accepts; it learns from labels of the input's own rows."""
    model = quality_model.train(docs, quality_model.labelled(read(spark, sf_dir, "labels")), ~held_out())
    return quality_model.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each component."""
    found = jaccard_join.components(docs)
    losers = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat a smaller document's."""
    kept = suffix_dedup.deduplicate(_packed(docs), "other_columns", as_text=True)
    kept = kept.filter("n_removed = 0 or n_removed < n_bytes")
    return _unpacked(kept.select("doc_id", "other_columns", F.col("kept").alias("text")), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark spans; drop documents that mostly consist of them."""
    marked = decontamination.decontaminate(_packed(docs), read(spark, sf_dir, "benchmark"), "other_columns")
    kept = marked.filter(f"100 * n_hit <= {MAX_HIT_PERCENT} * n_words")
    return _unpacked(kept.select("doc_id", "other_columns", F.col("cleaned").alias("text")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every text."""
    return sentencepiece_bpe.encode(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: No stage but decontamination can be expressed in SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir))[0]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
