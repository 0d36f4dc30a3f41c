import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from reportmesh.functions import ids, locations, text


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def expected_normal(value):
    out = unicodedata.normalize("NFKC", value).casefold()
    out = "".join(" " if unicodedata.category(c).startswith("P") else c for c in out)
    out = " ".join(out.split())
    for source in sorted(text.ALIASES, key=len, reverse=True):
        out = re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", text.ALIASES[source], out)
    return " ".join(out.split())


TRICKY = [
    "Jln dpn skolah ada longkang sumbat",
    "Lampu jln rosak",
    "  BLK-5, Tmn Maju!!  ",
    "Straße ＦＵＬＬ width ﬁne",
    "naïve — “quoted” text… ½ jln²",
    "İstanbul ΣΑΣ jln jln kg",
    "sk smk skolah kat kg",
    "jln_one jlnx xjln jln",
    "emoji 🚧 jln 🚧",
    "tab\tnew\nline\x1cfs\x85nel",
    "$5 flood + price",
    "café́ combining",
    "١٢٣ بلوك",
]


def test_normalize_matches_definition_and_is_idempotent(spark):
    got = column(spark, TRICKY, text.normalize_text)
    assert got == [expected_normal(t) for t in TRICKY]
    assert column(spark, got, text.normalize_text) == got
    assert got[0] == "jalan depan sekolah ada longkang tersumbat"
    assert got[1] == "lampu jalan rosak"


def test_whole_documents_normalise_like_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = docs.select("text", text.normalize_text(F.col("text")).alias("n")).collect()
    assert got and all(r["n"] == expected_normal(r["text"]) for r in got)


@pytest.mark.parametrize(
    ("normalized", "category", "terms", "review"),
    [
        ("pothole near shop", "pothole", ["pothole"], False),
        ("flash flood and banjir", "flooding", ["banjir", "flash flood", "flood"], False),
        ("pothole and garbage", "other", ["garbage", "pothole"], True),
        ("potholes everywhere", "other", [], True),
        ("nothing here", "other", [], True),
    ],
)
def test_classify(spark, normalized, category, terms, review):
    (got,) = column(spark, [normalized], text.classify_category)
    assert (got["category"], got["matched_terms"], got["review_required"]) == (
        category, terms, review,
    )


ACTIVE = [
    "road under flood", "road is flooding", "road was flooded", "banjir sedang berlaku",
    "air naik dan jalan banjir", "no rain yesterday but the road is flooded",
    "not flood but real flood here", "flooded last night and still deep",
]
INACTIVE = [
    "flooding has subsided", "was flooded last week but clear now", "road is no longer flooded",
    "not currently flooding", "tak banjir", "banjir sudah surut", "flooded with complaints",
    "floodlight rosak", "no flooding near the road",
]


def test_flooding_context(spark):
    got = column(spark, ACTIVE + INACTIVE, text.active_flooding_hits)
    assert [bool(g) for g in got] == [True] * len(ACTIVE) + [False] * len(INACTIVE)


def test_negation_looks_two_words_back(spark):
    values = [
        "tiada kemalangan and no accident", "no serious accident", "no one saw the accident",
        "accident no accident", "live wire",
    ]
    terms = ["accident", "kemalangan", "live wire"]
    got = column(spark, values, lambda c: text.term_hits(c, terms))
    assert got == [[], [], ["accident"], ["accident"], ["live wire"]]


def test_locations(spark):
    values = [
        "block a", "blok a jalan ampang", "unit b 2 unit b", "near school",
        "sekolah kebangsaan taman maju", "jalan rosak", "block 7 and block 7",
        "hospital seri block_9 blockade", "pasar besar near block x",
    ]
    got = column(spark, values, locations.extract_locations)
    pairs = [[(e["kind"], e["value"]) for e in g] for g in got]
    assert pairs == [
        [("block", "a")],
        [("block", "a"), ("street", "ampang")],
        [("unit", "b")],
        [],
        [("street", "maju"), ("landmark", "school:taman maju")],
        [],
        [("block", "7")],
        [("landmark", "hospital:seri block_9 blockade")],
        [("block", "x"), ("landmark", "market:besar")],
    ]


@pytest.mark.parametrize(
    ("a", "b", "state"),
    [
        ("block a", "blok a jalan ampang", "compatible"),
        ("block a", "block b", "conflicting"),
        ("block a jalan ampang", "block a jalan duta", "conflicting"),
        ("block a", "nothing", "unknown"),
        ("block a", "jalan ampang", "unknown"),
    ],
)
def test_compare_locations(spark, a, b, state):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    c = locations.compare_locations(
        locations.extract_locations(F.col("a")), locations.extract_locations(F.col("b"))
    )
    assert df.select(c["compatibility"].alias("s")).first()["s"] == state


def test_uuid5_equals_the_standard(spark):
    names = ["", "a", "incident-v1:x,y", "ünï"]
    assert column(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
