"""Spot signatures, vector codes and fill-in-the-middle against plain definitions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportmesh.llm import fill_in_middle as fm
from reportmesh.llm import spot_signatures as ss
from reportmesh.llm import vector_codes as vc
from reportmesh.llm.flat import flat

from . import brute
from .test_operators import CLASHING, _texts

LONG = 1_300_000  # above one block


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    prose = " ".join(rnd.choice(ss.COMMON.split() if rnd.random() < 0.4 else ["alpha", "Beta", "gamma's", "naïve", "x-ray"]) for _ in range(300))
    more = [prose, prose, prose.upper(), "the", "the of and", "word", "a <P> b", "<S>", "<M> and <P>", "<P", "tail <S", "the quick brown fox"]
    more += [" ".join(rnd.choices(prose.split(), k=rnd.randrange(1, 400))) for _ in range(25)]
    return [(3 * k - 40, t) for k, t in enumerate(_texts() + more)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = (*CLASHING, "block", "body", "copied", "form", "output", "restored", "n_chars")
    return df.withColumns({c: F.lit("other") for c in names}).cache()


def test_spot_signatures_equal_the_definition(rows):
    texts = [t for _, t in rows]
    sets, ends = ss.signatures(*flat(pa.array(texts)))
    want = [brute.spots(t, ss.COMMON, ss.GAP) for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in want]
    mine = [sets[a:b] for a, b in zip(ends, ends[1:])]
    for a in range(0, len(texts), 3):
        for b in range(0, len(texts), 7):
            assert len(np.intersect1d(mine[a], mine[b])) == len(want[a] & want[b])
    for text, own in zip(ss.written(sets, ends), mine):
        assert ss.parsed(text).tolist() == own.tolist()


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_edited_texts(spark, docs, rows, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r.doc_id: r for r in ss.with_edits(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    changed, texts = brute.edited(rows), {i: t or "" for i, t in rows}
    spots = {i: brute.spots(t, ss.COMMON, ss.GAP) for i, t in texts.items()}
    order = sorted(texts)
    assert len(got) == len(rows)
    for k, i in enumerate(order):
        r, following = got[i], order[(k + 1) % len(order)]
        assert (r.n_chars, r.edited_sha256, r.n_signatures) == (len(texts[i]), _sha(changed[i]), len(spots[i]))
        assert r.near_edited == pytest.approx(brute.jaccard(spots[i], brute.spots(changed[i], ss.COMMON, ss.GAP)))
        assert r.near_next == pytest.approx(brute.jaccard(spots[i], spots[following]))
        assert (r.edited_is_copy, r.next_is_copy) == (r.near_edited >= ss.LEAST, r.near_next >= ss.LEAST)
        assert r.n_edited_signatures * 6 == len(__import__("base64").b64decode(r.edited_fingerprint))
    plain = {r.doc_id: r.fingerprint for r in ss.fingerprints(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_edited_texts_of_awkward_rows(spark, docs):
    assert ss.with_edits(docs.limit(0)).count() == 0 and ss.fingerprints(docs.limit(0)).count() == 0
    one = ss.with_edits(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(_sha("abab"), 1.0)]
    long = "über the " * (LONG // 9)
    df = spark.createDataFrame([(None, "the one two"), (None, None), (1, long), (1, long), (1, "the x"), (9, "y"), (None, "")], "doc_id long, text string")
    got = ss.with_edits(df.repartition(3)).collect()
    assert len(got) == 7 and {r.near_next for r in got if r.doc_id is None and r.n_chars} == {0.0}
    assert {r.edited_sha256 for r in got if r.doc_id is None and r.n_chars} == {_sha("the on")}
    assert {r.near_next for r in got if r.doc_id is None and not r.n_chars} == {1.0}
    same = sorted((t for t in (long, long, "the x")), key=lambda t: hashlib.md5(t.encode()).digest())
    follows = [*same[1:], "y"]
    want = sorted(_sha(ss.edited_text(t, f)) for t, f in zip(same, follows))
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 1) == want


def test_pruned_likeness_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(3)
    sizes = [0, 0, 1, 3, 4, 40, 400]
    pick = lambda: [np.unique(rng.integers(0, 60 if k < 100 else 500, k)).astype(np.uint64) for k in sizes for _ in range(6)]
    a, b = pick(), pick()
    b[-4:] = [x[: int(len(x) * s)] for x, s in zip(a[-4:], (0.74, 0.76, 0.9, 1))]
    pack = lambda sets: (np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    want = np.array([brute.jaccard(set(x.tolist()), set(y.tolist())) for x, y in zip(a, b)])
    assert ss.likeness(pack(a), pack(b)) == pytest.approx(want)
    assert ss.likeness(pack(a), pack(b), 0.75) == pytest.approx(np.where(want >= 0.75, want, 0))
    n = np.arange(1, 3000)
    part = ss.partition_of(n, 0.75)
    for k in n[::37]:
        assert part[min(int(k / 0.75), 2999) - 1] - part[k - 1] <= 1


def _vectors(n, dimension, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dimension)).astype(np.float32)
    v[n // 2 :: 5] = v[3]
    v[7] *= 200
    return [(int(i), [float(x) for x in row]) for i, row in zip(rng.permutation(n) * 3 - 50, v)]


@pytest.mark.parametrize(("n", "dimension", "scale"), [(300, 64, 1.0), (40, 16, 1.0), (200, 32, 3_000.0)])
def test_vector_codes_equal_integer_arithmetic(spark, n, dimension, scale):
    rows = [(i, [x * scale for x in v]) for i, v in _vectors(n, dimension, n)]
    bad = [(10_001, None), (10_002, [None] * dimension), (-999, [float("nan")] * dimension), (10_004, [float("inf")] + [0.0] * (dimension - 1)),
           (-998, [0.5] * (dimension - 1) + [None])]
    df = spark.createDataFrame([(i, v, [3, None, 5][i % 3]) for i, v in rows + bad], "vec_id long, embedding array<double>, label int").repartition(4)
    df = df.withColumns({c: F.lit("other") for c in ("code", "error", "v", "slot", "n", "_label", "label_error")})
    want, books = brute.vector_codes(rows + bad)
    codebooks = vc.train(df)
    assert [[tuple(e) for e in book] for book in codebooks.tolist()] == books
    got = vc.label_errors(vc.encode(df, codebooks)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == n
    total = {}
    for r in got:
        total[r.label] = total.get(r.label, 0) + r.error
    assert all(r.label_error == total[r.label] for r in got)
    decoded = vc.decode(got[0].code, codebooks)
    assert len(decoded) == dimension


def test_products_over_limbs_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 26, (1 << 27) + 12345):
        x, c = rng.integers(-top, top, (2, 9, 4)), rng.integers(-top, top, (2, 5, 4))
        want = [[[sum(int(a) * int(b) for a, b in zip(p, q)) for q in cs] for p in xs] for xs, cs in zip(x, c)]
        assert vc.dots(x, c).tolist() == want


def test_vector_codes_of_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(None, [1.0] * 16, "a"), (2, [2.0] * 16, "a"), (2, [0.0] * 16, None), (1, [], "b"), (5, [1.0] * 15, "a"), (6, [1.0] * 32, None), (2, [2.0] * 16, "a")]
    df = spark.createDataFrame(rows, schema)
    codebooks = vc.train(df)
    assert codebooks.shape == (16, 4, 1) and codebooks[0, :, 0].tolist() == [0, 512, 512, 256]
    got = sorted((str(r.vec_id), r.label or "", r.code or "", r.error) for r in vc.encode(df, codebooks).collect())
    assert got == sorted(
        [("None", "a", "03" * 16, 0), ("2", "a", "01" * 16, 0), ("2", "a", "01" * 16, 0), ("2", "", "00" * 16, 0),
         ("1", "b", "", None), ("5", "a", "", None), ("6", "", "", None)], key=lambda r: r[:3],
    )
    empty = spark.createDataFrame([], schema)
    assert vc.train(empty).shape[1] == 0 and vc.label_errors(vc.encode(empty, vc.train(empty))).count() == 0
    only_short = spark.createDataFrame([(1, [1.0], "a")], schema)
    assert [r.code for r in vc.label_errors(vc.encode(only_short, vc.train(only_short))).collect()] == [None]
    with pytest.raises(Exception, match="64 bits"):
        vc.train(spark.createDataFrame([(1, [1e9] * 16, "a")], schema))


def test_label_errors_split_hot_labels(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as vec_id", "cast(if(id % 3 = 0, null, id % 2) as int) as label", "hex(id) as code", "id as error")
    want = {r.label: r.s for r in df.groupBy("label").agg(F.sum("error").alias("s")).collect()}
    monkeypatch.setattr(vc.lookup, "__kwdefaults__", {**vc.lookup.__kwdefaults__, "hot_rows": 50})
    got = vc.label_errors(df).collect()
    assert len(got) == 500 and all(r.label_error == want[r.label] for r in got)


def test_fill_in_middle_equals_the_definition(docs, rows):
    out = fm.restore(fm.fill_in_middle(docs)).collect()
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out}
    assert got == {i: brute.fill_in_middle(i, t) for i, t in rows}
    assert {r.doc_id: r.restored for r in out} == {i: t or "" for i, t in rows}
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_awkward_rows(spark, docs):
    assert fm.restore(fm.fill_in_middle(docs.limit(0))).count() == 0
    long = "aé日😀" * (LONG // 4)
    df = spark.createDataFrame([(i, long) for i in range(12)] + [(None, "null id"), (None, None), (3, "x"), (3, "x")], "doc_id long, text string")
    out = fm.restore(fm.fill_in_middle(df)).collect()
    assert all(r.restored == (long if r.n > 10 else r.restored) for r in out) and sum(r.n == len(long) for r in out) == 12
    for r in out:
        if r.doc_id is not None and r.n == len(long):
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.fill_in_middle(r.doc_id, long)
    assert len({r.output for r in out if r.n == 1}) == 1
    everything = {fm.arranged(b"<P<S<M<", [a, b, 0, s], 10, 20)[0] for a in range(9) for b in range(9) for s in (0, 50)}
    assert len(everything) > 30
    for a in range(9):
        for b in range(9):
            for s in (0, 50):
                output, form, *_ = fm.arranged(b"<P<S<M<", [a, b, 0, s], 10, 20)
                assert fm.restored(output, form) == b"<P<S<M<"


def test_long_words_are_counted_like_short_ones(monkeypatch):
    from reportmesh.llm import token_counts as tc
    from reportmesh.llm.frames import tokenizer_file

    scan = tc.automaton(tokenizer_file(tc.VOCABULARY))
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "the", "é", "日", "0", "xq"]) for _ in range(n)) for n in (1, 5, 60, 100, 127, 400, 900)]
    data, offsets = flat(pa.array([t.encode() for t in texts], pa.large_binary()))
    whole = scan.counts(data, offsets[:-1], offsets[1:])
    monkeypatch.setattr(tc, "LONG_WORD", 0)
    assert scan.counts(data, offsets[:-1], offsets[1:]).tolist() == whole.tolist()
    monkeypatch.setattr(tc, "LONG_WORD", 1 << 30)
    assert scan.counts(data, offsets[:-1], offsets[1:]).tolist() == whole.tolist()
