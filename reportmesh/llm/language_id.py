"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters'
vectors, each permuted (rotated) by its place; a document bundles (adds) the vectors of all its n-grams;
a language prototype bundles the unit vectors of its documents. A document takes the language whose
prototype has the highest cosine with it. Letters are lower-cased; every run of other characters is one
blank, which takes part in n-grams as a letter of its own.

Learning covers all documents with a language that the caller marks; sums are integers, so results do
not depend on the order of rows. Prototypes are sums per language and dimension; a slice of the languages
is broadcast at a time, so their number has no limit.

A null text, or one without a letter, is ``und`` with score 0. Rows with a null language teach nothing.
Ties go to the language that sorts first. Without any language to learn from, all are ``und``. Rows that
repeat an id are predicted one by one; an empty table gives an empty one. Only doc_id, text and, for
learning, lang are read. A text is never cut: a block holds at least one whole row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import flat_blocks
from .frames import documents, held_out, map_arrow, read

DIMENSIONS = 1024
GRAM = 3
#: Languages whose prototypes are broadcast at a time; more are scored in several passes.
SLICE = 4096
_UNIT = 1 << 20
_BLOCK = 1_500_000
_BLANK = 0x20


@lru_cache(maxsize=1 << 16)
def _letter(point: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([7, point]).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1 << 17)
def _folded(point: int) -> int:
    """Lower-case letter of a character, or a blank; characters that fold to several keep the first."""
    c = chr(point)
    return ord(c.lower()[0]) if c.isalpha() else _BLANK


def vectors(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each row (float32), and whether it has a letter."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    before = np.r_[0, np.cumsum(lead)]
    row_ends = before[offsets]
    row = np.repeat(np.arange(n), np.diff(row_ends))
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
    table[seen] = [_folded(int(p)) for p in seen]
    letters = table[points]
    # a blank at both ends of each row, and one for each run of other characters
    size = len(letters) + 2 * n
    padded, owner = np.full(size, _BLANK, np.int64), np.repeat(np.arange(n), np.diff(row_ends) + 2)
    body = np.arange(len(letters)) + 2 * row + 1
    padded[body] = letters
    keep = np.ones(size, bool)
    keep[1:] = ~((padded[1:] == _BLANK) & (padded[:-1] == _BLANK) & (owner[1:] == owner[:-1]))
    padded, owner = padded[keep], owner[keep]
    has = np.zeros(n, bool)
    has[owner[padded != _BLANK]] = True
    out = np.zeros((n, dimensions), np.float32)
    if len(padded) < gram:
        return out, has
    alphabet, code = np.unique(padded, return_inverse=True)
    a = len(alphabet)
    window = len(padded) - gram + 1
    if a**gram * n >= 1 << 62 and n > 1:  # too many different letters for one number: fewer rows at a time
        cut = n // 2
        parts = [vectors(data[o[0] : o[-1]], o - o[0], dimensions, gram) for o in (offsets[: cut + 1], offsets[cut:])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ids = np.zeros(window, np.int64)
    for k in range(gram):
        ids = ids * a + code[k : k + window]
    inside = owner[:window] == owner[gram - 1 :]
    cells, counts = np.unique(owner[:window][inside] * a**gram + ids[inside], return_counts=True)
    rows, gram_of = cells // a**gram, cells % a**gram
    known, column = np.unique(gram_of, return_inverse=True)
    base = np.stack([_letter(int(p), dimensions) for p in alphabet])
    turned = [np.roll(base, gram - 1 - k, 1) for k in range(gram)]
    for low in range(0, len(known), 4096):  # n-gram vectors exist for one slice at a time
        part = known[low : low + 4096]
        bound = turned[0][part // a ** (gram - 1)]
        for k in range(1, gram):
            bound = bound * turned[k][part // a ** (gram - 1 - k) % a]
        here = (column >= low) & (column < low + 4096)
        bound = bound.astype(np.float32)
        for top in range(0, n, 512):
            mine = here & (rows >= top) & (rows < top + 512)
            dense = np.zeros((min(512, n - top), len(part)), np.float32)
            dense[rows[mine] - top, column[mine] - low] = counts[mine]
            out[top : top + 512] += dense @ bound
    return out, has


def learn(docs: DataFrame, teaches: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototype sums (lang, dim, value) over all documents that teach. ``docs`` has text and lang."""
    rows = docs.filter(teaches & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))

    def rows_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():  # one row per language and dimension, summed map-side again
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)],
                ["lang", "dim", "value"],
            )

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang")
            for i, j, data, offsets in flat_blocks(batch.column("text"), _BLOCK):
                v, _ = vectors(data, offsets, dimensions)
                length = np.sqrt((v * v).sum(1, dtype=np.float64))
                unit = np.rint(v / np.maximum(length, 1e-9)[:, None] * _UNIT).astype(np.int64)
                own = np.array(langs.slice(i, j - i).to_pylist(), object)
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + unit[own == lang].sum(0)
                if len(sums) > SLICE:
                    yield from rows_of(sums)
                    sums = {}
        yield from rows_of(sums)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return rows.mapInArrow(every, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


Model = list[tuple[list[str], np.ndarray]]


def prototypes(sums: DataFrame, dimensions: int = DIMENSIONS) -> Model:
    """Slices of (languages, unit prototypes), in the order of the languages' names.

    A language reaches the driver as one row of ``dimensions`` numbers; there are as many as languages.
    """
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    langs, found = [], []
    for r in rows.select("lang", F.col("v.value").alias("v")).orderBy("lang").toLocalIterator():
        v = np.array(r.v, np.float64)
        langs.append(r.lang)
        found.append((v / max(np.sqrt((v * v).sum()), 1e-9)).astype(np.float32))
    order = sorted(range(len(langs)), key=langs.__getitem__)
    slices = [order[k : k + SLICE] for k in range(0, len(order), SLICE)]
    return [([langs[k] for k in part], np.stack([found[k] for k in part])) for part in slices]


def predict(docs: DataFrame, model: Model, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score); the score maps the best cosine from -1..1 to 0..1. Of equally good
    languages the first by name is taken.

    A slice of the model is broadcast at a time; each pass keeps the best language so far.
    """
    own = documents(docs).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0)})
    slices = model or [([], np.zeros((0, dimensions), np.float32))]
    for k, part in enumerate(slices):
        own = _better(own, part, dimensions, k + 1 < len(slices))
    return own


def _better(docs: DataFrame, part: tuple[list[str], np.ndarray], dimensions: int, more: bool) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(part)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, proto = model.value
        for i, j, data, offsets in flat_blocks(batch.column("text"), _BLOCK):
            v, has = vectors(data, offsets, dimensions)
            has &= len(names) > 0
            length = np.maximum(np.sqrt((v * v).sum(1)), 1e-9)
            cosine = (v @ proto.T) / length[:, None] if names else np.zeros((j - i, 1), np.float32)
            best = cosine.argmax(1)
            score = np.clip((1 + cosine[np.arange(j - i), best].astype(np.float64)) / 2, 0, 1)
            before = batch.slice(i, j - i)
            past, lang = before.column("score").to_numpy(), before.column("lang_pred").to_pylist()
            first = np.array([x is None or x == "und" for x in lang], bool)
            wins = has & (first | (score > past))
            named = pa.array([names[b] if w else x or "und" for b, w, x in zip(best, wins, lang)], pa.string())
            columns = {"doc_id": before.column("doc_id"), "lang_pred": named, "score": pa.array(np.where(wins, score, past))}
            if more:  # the next pass reads the text again
                columns["text"] = before.column("text")
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs, one, "doc_id long, lang_pred string, score double" + (", text string" if more else ""))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = prototypes(learn(docs, ~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
