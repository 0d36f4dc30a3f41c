"""Which keys occur in more than one document, without meeting all rows of a frequent key.

A batch's rows of a key with more than ``BATCH_HOT`` owners are known to be shared: they get a salt, so
that they do not meet in one task, and two witness rows of the key tell the other batches. All other
keys meet in a window over (key, salt).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_HOT = 64
MANY = 1 << 60
SCHEMA = "key long, salt int, doc_id long, witness boolean"


def rows_of_keys(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch's different (key, owner) pairs, with witnesses."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[keep], owner[keep]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(fresh)
    size = np.diff(np.r_[head, len(key)]).astype(np.int64)
    many = size > BATCH_HOT
    salt = np.where(np.repeat(many, size), 1 + (owner & 0x3FF), 0)
    ends = np.r_[head[many], (head + size - 1)[many]].astype(np.int64)
    witness = np.r_[np.zeros(len(owner), bool), np.ones(len(ends), bool)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[key, key[ends]]),
            pa.array(np.r_[salt, np.zeros(len(ends), np.int64)].astype(np.int32)),
            pa.array(np.r_[owner, owner[ends]]),
            pa.array(witness),
        ],
        ["key", "salt", "doc_id", "witness"],
    )


def shared(rows: DataFrame) -> DataFrame:
    """(doc_id, key, df): pairs whose key other documents have too, with the number of documents, or
    MANY where a batch alone had more than BATCH_HOT. All documents agree about a key."""
    group = Window.partitionBy("key", "salt")
    seen = rows.select(
        "doc_id", "key", "salt", "witness",
        F.min("doc_id").over(group).alias("low"), F.max("doc_id").over(group).alias("high"),
        F.max("witness").over(group).alias("told"), F.count(F.lit(1)).over(group).alias("n"),
    )
    known = F.col("salt") > 0
    return seen.filter(~F.col("witness") & (known | (F.col("low") < F.col("high")))).select(
        "doc_id", "key", F.when(known | F.col("told"), F.lit(MANY)).otherwise(F.col("n")).alias("df")
    )
