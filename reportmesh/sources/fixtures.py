"""Report tables derived from the given ``events`` and ``embeddings`` tables.

Integer arithmetic only, so another SQL engine reproduces every value. All derived tables grow
with the given ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import review_id
from ..functions.locations import extract_locations
from ..functions.text import normalize_text
from ..policy import CATEGORIES
from ..session import configure, spread

# Phrases per category (in CATEGORIES order), and prefixes that trip or dodge the safety lexicon.
PHRASES = (
    ("Pothole on the road", "Lubang jalan", "Deep road hole"),
    ("Longkang sumbat", "Drain blocked!", "Blocked drain again"),
    ("Banjir besar", "Flash flood", "Air naik cepat"),
    ("Sampah tak kutip", "Garbage pile", "Overflowing bin"),
    ("Lampu jln rosak", "Street light out", "Streetlight blinking"),
    ("Something odd", "Noise complaint", "Stray dogs"),
)
PREFIXES = (
    "",
    "No injury. ",
    "Exposed wire seen. ",
    "Flood receded today. ",
    "Not flooded, ",
    "Accident reported. ",
    "Blocked road ahead - ",
    "Was flooded last night but clear. ",
)

# Hashing keeps the product inside 64 bits for any id: ids are first reduced modulo 2**31.
_HASH = "(((event_id % 2147483648) * {m}) % 4294967296) div 4096"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal_array(values) -> str:
    return "array(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean reports before any text processing."""
    flat_phrases = _literal_array([p for group in PHRASES for p in group])
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    hashed = events.selectExpr(
        "event_id",
        "cast(ts as timestamp) as reported_at",
        f"{_HASH.format(m=2654435761)} as h1",
        f"{_HASH.format(m=2246822519)} as h2",
        f"{_HASH.format(m=3266489917)} as h3",
    )
    keyed = hashed.selectExpr(
        "*", "h1 % 400 as z", "case when h2 % 20 = 19 then 5 else h2 % 5 end as cat"
    )
    return keyed.selectExpr(
        "event_id",
        "concat('00000000-0000-0000-0000-', lpad(cast(event_id as string), 12, '0')) as id",
        "z",
        "cat",
        "((h2 div 20) % 4) * 0.25D as w",
        f"""concat(
            element_at({_literal_array(PREFIXES)}, cast((h2 div 80) % 8 as int) + 1),
            element_at({flat_phrases}, cast(cat * 3 + (h1 div 400) % 3 as int) + 1),
            case when event_id % 7 < 4
                 then concat(case when event_id % 2 = 0 then ' at Block ' else ' at Blk ' end,
                             element_at(array('A','B','C'), cast((h3 div 8633) % 3 as int) + 1))
                 else '' end,
            case when event_id % 10 = 0
                 then concat(' unit ', cast(event_id % 3 as string)) else '' end) as text""",
        "3.0D + (z div 20) * 0.02D + (h3 % 97) * 0.00008D as latitude",
        "101.4D + (z % 20) * 0.02D + ((h3 div 97) % 89) * 0.00008D as longitude",
        "reported_at",
        f"element_at({_literal_array(CATEGORIES)}, cast(cat as int) + 1) as category",
        "case when event_id % 4 = 0 then 'photo.jpg' end as photo_path",
    )


def complaints(spark: SparkSession, sf_dir: str, *, with_locations: bool = True) -> DataFrame:
    """Reports with normalised text and extracted places. """
    df = reports(spark, sf_dir).select(
        "id",
        "text",
        normalize_text(F.col("text")).alias("normalized_text"),
        "latitude",
        "longitude",
        "reported_at",
        "category",
        "photo_path",
    )
    if with_locations:
        df = df.withColumn("locations", extract_locations(F.col("normalized_text")))
    return df


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blended vector per report: a place-and-category anchor plus weighted noise."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1))).scalar()
    keyed = reports(spark, sf_dir).select(
        "id",
        "w",
        ((F.col("z") * 6 + F.col("cat")) % n).alias("anchor_id"),
        ((F.col("event_id") * 11) % n).alias("noise_id"),
    )
    anchor = emb.select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("anchor"))
    noise = emb.select(F.col("vec_id").alias("noise_id"), F.col("embedding").alias("noise"))
    return (
        keyed.join(anchor, "anchor_id")
        .join(noise, "noise_id")
        .select(
            "id",
            F.zip_with(
                "anchor",
                "noise",
                lambda a, b: a.cast("double") + F.col("w") * b.cast("double"),
            ).alias("vector"),
        )
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth for evaluation: reports of one anchor describe the same thing."""
    return reports(spark, sf_dir).select("id", (F.col("z") * 6 + F.col("cat")).alias("anchor"))


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unvalidated intake: padded or short text, bad coordinates, future times, bad fields."""
    return reports(spark, sf_dir).selectExpr(
        "event_id",
        "id",
        """case when event_id % 31 = 0 then '  x  '
                when event_id % 37 = 0 then repeat('flood ', 400)
                else concat('  ', text, ' ') end as text""",
        """case when event_id % 41 = 0 then 91.5D when event_id % 43 = 0 then double('NaN')
                else latitude end as latitude""",
        "case when event_id % 47 = 0 then -180.5D else longitude end as longitude",
        """case when event_id % 53 = 0 then reported_at + interval 400 days
                when event_id % 59 = 0 then null else reported_at end as reported_at""",
        """case when event_id % 61 = 0 then 'volcano' when event_id % 3 = 0 then null
                else category end as category""",
        """case when event_id % 67 = 0 then concat('uploads/', id, '.jpg')
                when event_id % 4 = 0 then 'photo.jpg' end as photo_path""",
        "case when event_id % 71 = 0 then id end as photo_id",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered command log: first sends, replays (every 10th) and altered re-sends (every 25th)."""
    base = reports(spark, sf_dir).selectExpr(
        "event_id",
        "concat('key-', event_id) as idempotency_key",
        "id as complaint_id",
        "text",
        "latitude",
        "longitude",
        "reported_at",
        "category",
        "photo_path",
    )
    first = base.withColumn("sequence", F.col("event_id") * 3)
    replay = base.filter("event_id % 10 = 0").withColumn("sequence", F.col("event_id") * 3 + 1)
    altered = base.filter("event_id % 25 = 0").withColumns(
        {"sequence": F.col("event_id") * 3 + 2, "text": F.concat(F.col("text"), F.lit(" updated"))}
    )
    return first.unionByName(replay).unionByName(altered)


def sensitive_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per tenth zone that has reports, alternating school and hospital."""
    return (
        reports(spark, sf_dir)
        .filter("z % 10 = 0")
        .select("z")
        .distinct()
        .selectExpr(
            "concat('place-', z) as place_id",
            "case when (z div 10) % 2 = 0 then 'school' else 'Hospital' end as kind",
            "3.0D + (z div 20) * 0.02D + 0.0035D as latitude",
            "101.4D + (z % 20) * 0.02D + 0.0035D as longitude",
        )
    )


def reviews(matched: DataFrame, complaints: DataFrame) -> DataFrame:
    """One review per review-required pair: a twelfth approved, a twelfth rejected, rest pending."""
    tail = lambda c: F.substring(c, 25, 12).cast("bigint")
    rule = (tail("left_id") + tail("right_id")) % 12
    times = complaints.select("id", "reported_at")
    left = times.toDF("left_id", "left_at")
    right = times.toDF("right_id", "right_at")
    base = (
        matched.filter(F.col("decision") == "review_required")
        .select("left_id", "right_id", F.array_join("reasons", "; ").alias("matcher_reasons"))
        .join(left, "left_id")
        .join(right, "right_id")
        .withColumn("rule", rule)
    )
    resolved = F.col("rule").isin(1, 2)
    final = F.when(F.col("rule") == 1, F.lit("auto_match")).when(
        F.col("rule") == 2, F.lit("no_match")
    )
    created = F.greatest("left_at", "right_at")
    return base.select(
        review_id(F.col("left_id"), F.col("right_id")).alias("review_id"),
        "left_id",
        "right_id",
        F.lit("review_required").alias("matcher_recommendation"),
        "matcher_reasons",
        F.when(F.col("rule") == 1, F.lit("approved"))
        .when(F.col("rule") == 2, F.lit("rejected"))
        .otherwise(F.lit("pending"))
        .alias("status"),
        created.alias("created_at"),
        F.when(resolved, created + F.expr("interval 1 hour")).alias("resolved_at"),
        F.when(resolved, F.concat(F.lit("officer-"), (tail("left_id") % 5).cast("string"))).alias(
            "reviewed_by"
        ),
        F.when(resolved & (tail("right_id") % 2 == 0), F.lit("checked on site")).alias(
            "review_note"
        ),
        final.alias("final_relationship_state"),
        F.when(resolved, F.lit("officer_review")).alias("decision_source"),
        F.lit("graph-1").alias("graph_version_at_creation"),
        F.when(resolved, F.lit(2)).otherwise(F.lit(1)).alias("version"),
    )
