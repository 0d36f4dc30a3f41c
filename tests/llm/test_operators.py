"""Operators for training text against plain definitions, with awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportmesh.llm import decontamination as dc
from reportmesh.llm import jaccard_join as jj
from reportmesh.llm import language_id as li
from reportmesh.llm import licence_scan as ls
from reportmesh.llm import quality_model as qm
from reportmesh.llm import quality_rules as qr
from reportmesh.llm import sentencepiece_bpe as sp
from reportmesh.llm import sharing
from reportmesh.llm import suffix_dedup as sd
from reportmesh.llm import token_counts as tc
from reportmesh.llm import token_files as tf
from reportmesh.llm.collection_bwt import build, smallest_owner, suffix_places
from reportmesh.llm.flat import flat_blocks
from reportmesh.llm.frames import tokenizer_file

from . import brute

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside, on columns they must not read.
CLASHING = ("key", "digest", "segment", "copied", "n", "id", "shingles", "label", "score", "ids", "decoded", "words", "lines", "cleaned", "row_key")


def _texts() -> list:
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["th", "an", "er", "on", "é", "ß", "日", "x1"]) for _ in range(rnd.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = [word() for _ in range(120)], prose(60)
    out = [None, "", "   \n\t ", "a", "A a", "one two three four", "ONE two three four", "x" * 49, "x" * 50, "y" * 3000, "y" * 3000]
    out += ["ab" * 400, "b" + "ab" * 300, prose(3000), " ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in range(40):  # near copies, some of them linked only through others
        w = list(base)
        for _ in range(k % 9):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [prose(rnd.randrange(5, 80)) + "\n" + passage + "\n" + prose(rnd.randrange(80)) for _ in range(12)]
    out += [prose(rnd.randrange(1, 200)) for _ in range(40)]
    out += ["<s> </s> ▁▁ <|endoftext|>   z", "日本語 テスト 😀😀 " * 30, "\u0000\u0001 tab\tend\r\n\r\nlast"]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows twice over where ids allow, null ids, and clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("other") for c in CLASHING}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _by_id(df, *columns) -> dict:
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_jaccard_components(docs, rows, empty):
    assert _by_id(jj.components(docs), "n_shingles", "component_id") == brute.components(rows)
    assert jj.components(empty).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (9, text), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id) for r in jj.components(df).collect())
    assert got == [(False, 0, None), (False, 0, None), (True, 2, 2), (True, 4, 4), (True, 4, 4), (True, 9, 4)]


@pytest.mark.parametrize("classes", [3, 2048])
def test_jaccard_split_blocks(docs, rows, classes, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_CLASSES", classes)
    assert _by_id(jj.components(docs), "n_shingles", "component_id") == brute.components(rows)


@pytest.mark.parametrize("classes", [3, 2048])
def test_jaccard_ids_with_several_texts(spark, rows, classes, monkeypatch):
    """An id links by each of its texts, and all its rows have one component."""
    monkeypatch.setattr(jj, "BLOCK_CLASSES", classes)
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words[:30]), " ".join(words[30:])
    long = " ".join(f"long{k}" for k in range(400))
    near = lambda text, k: f"{text} more{k}"
    same = [(5, a), (5, b), (5, ""), (7, near(b, 1)), (3, near(a, 2)), (9, b), (2, "one two three four five"), (9, "one two three four five"), (11, long), (11, "x y z q r s t u v w"), (12, "x y z q r s t u v w p"), (13, near(long, 4))]
    same += [(100 + i // 3 if i % 7 else 100 + i, t) for i, t in rows]
    of_row = brute.components([(k, t) for k, (_, t) in enumerate(same)])
    name = {i: i for i, _ in same}
    while True:  # the smallest id spreads over rows of an id and rows of a component
        by_root = {}
        for k, (i, _) in enumerate(same):
            by_root[of_row[k][1]] = min(by_root.get(of_row[k][1], i), name[i])
        new = dict(name)
        for k, (i, _) in enumerate(same):
            new[i] = min(new[i], by_root[of_row[k][1]], name[by_root[of_row[k][1]]])
        if new == name:
            break
        name = new
    got = jj.components(spark.createDataFrame(same, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, of_row[k][0], name[i]) for k, (i, _) in enumerate(same))
    assert name[13] == 11 and name[12] == 11 and name[7] == name[9] == 2


def test_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 40, 30)
        sets = [np.unique(np.where(rng.random(30) < 0.12, rng.integers(0, 90, 30), base)) for _ in range(rng.integers(1, 25))]
        n = np.array([len(s) for s in sets])
        ids = rng.permutation(1000)[: len(sets)]
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= 75 * (n[a] + n[b] - o):
                    parent[find(a)] = find(b)
        want = [min(ids[j] for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))]
        assert jj.search(ids, n, np.concatenate(sets).astype(np.uint64)).tolist() == want


def test_collection_transform_orders_suffixes():
    rnd = random.Random(5)
    for _ in range(150):
        letters, window = rnd.choice([b"ab", b"abc", bytes(range(97, 123))]), rnd.choice([1, 2, 5])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(0, 25))) for _ in range(rnd.randrange(1, 30))]
        data = np.frombuffer(b"".join(strings) + b"a", np.uint8)[:-1]
        lengths = np.array([len(s) for s in strings], np.int64)
        starts = np.cumsum(lengths) - lengths
        bwt, prefix = build(data, starts, lengths)
        suffixes = sorted((s[p:], i) for i, s in enumerate(strings) for p in range(len(s)))
        place = {(i, len(s)): k for k, (s, i) in enumerate(suffixes)}
        want = [place[i, len(s) - p] + len(strings) for i, s in enumerate(strings) for p in range(len(s))]
        assert suffix_places(bwt, lengths).tolist() == want
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix[len(strings) + 1 :].tolist() == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
        owners = np.array([rnd.randrange(9) for _ in strings])
        best = {}
        for s, o in zip(strings, owners.tolist()):
            for p in range(len(s) - window + 1):
                best[s[p : p + window]] = min(best.get(s[p : p + window], 99), o)
        if len(data):
            _, got = smallest_owner(data, starts, lengths, owners, window)
            assert got.tolist() == [best[s[p : p + window]] for s in strings for p in range(len(s) - window + 1)]


def _spans(df) -> list:
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows)


def test_suffix_dedup(docs, rows, empty):
    assert _spans(sd.deduplicate(docs)) == brute.kept_bytes(rows)
    assert sd.deduplicate(empty).count() == 0


def test_suffix_dedup_hot_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(sd.kinds_of_strings, "__defaults__", (2,))
    assert _spans(sd.deduplicate(docs)) == brute.kept_bytes(rows)


def test_suffix_dedup_repeated_and_null_ids(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(120))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (8, "é" + text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed, bytes(r.kept)) for r in sd.deduplicate(df).collect())
    assert got == [(-1, 0, text.encode()), (3, 0, text.encode()), (3, 0, text.encode()), (8, 120, "é".encode())]


def test_only_strings_that_may_share_a_window_reach_the_transform():
    rnd = random.Random(9)
    text = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    for _ in range(40):
        gram, window = text(20), text(50)
        strings = [text(rnd.randrange(15, 30)) + gram + text(rnd.randrange(15, 30)) for _ in range(30)] + [b"", b"a" * 49]
        strings += [text(rnd.randrange(15)) + window + text(rnd.randrange(15)) for _ in range(3)]
        rnd.shuffle(strings)
        data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(s) for s in strings])]
        assert sd.may_share(data, offsets).tolist() == [window in s for s in strings]
    alone = np.frombuffer(b"a" * 113, np.uint8)  # equal windows of one string are no match
    assert sd.may_share(alone, np.array([0, 113])).tolist() == [False]


@pytest.mark.parametrize("hot", [2, sd.HOT])
def test_suffix_dedup_ids_with_several_texts(spark, rows, hot, monkeypatch):
    """Each row loses its own bytes, whatever other texts have its id."""
    monkeypatch.setattr(sd.kinds_of_strings, "__defaults__", (hot,))
    same = [(i // 4 * 4 if i < 60 else i, t) for i, t in rows]
    same += [(500, "short " + "".join(chr(97 + k * k % 26) for k in range(70))), (500, t := rows[13][1]), (501, t + "." * 60), (501, "no repeat"), (501, t + "." * 60)]
    df = spark.createDataFrame(same, "doc_id long, text string").repartition(3)
    assert _spans(sd.deduplicate(df)) == sorted(brute.kept_bytes(same))


def test_shared_keys_without_a_match(spark):
    """49 common bytes bring strings together, and none of them goes."""
    rnd = random.Random(1)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    common = noise(49)
    df = spark.createDataFrame([(n, noise(80) + str(n) + common + str(n) + noise(80)) for n in range(6)], "doc_id long, text string")
    assert {r.n_removed for r in sd.deduplicate(df).collect()} == {0}


def test_strings_of_many_batches(spark):
    """Kinds must agree with all pairs of rows, whatever batches the rows came in."""
    rng = np.random.default_rng(4)
    rows = []
    pairs = {(int(k), int(d) * 4, int(o)) for k, d, o in zip(rng.integers(0, 6, 900), rng.integers(0, 90, 900), rng.integers(0, 300, 900))}
    pairs |= {(9, d * 4, d) for d in range(900)} | {(9, 4, 9999), (10, 8, 5), (10, 8, 5), (11, 4, 1)}
    pairs = {(k << 40, d, o) for k, d, o in pairs}
    for b in ([p for p in pairs if p[2] % 3 == b] for b in range(3)):
        rows += sd.string_rows(*(np.array(c) for c in zip(*b))).to_pylist()
    found = sd.kinds_of_strings(spark.createDataFrame(rows, "key long, salt int, digest long, doc_id long, witness boolean")).collect()
    got = {(r.doc_id, t & ~3): t & 3 for r in found for t in r.tags}
    for k, d, o in pairs:
        first = min(x[2] for x in pairs if x[:2] == (k, d))
        others = any(x[0] == k and x[1] != d for x in pairs)
        kind = got.get((o, (k ^ d) & ~3), 0)
        # the smallest owner always meets the other strings of its key; copies may follow or meet them too
        assert (kind in (2, 3)) == others if first == o else kind == 1 or (kind in (2, 3) and others), (k, d, o, kind)


def test_shared_keys_with_witnesses(spark):
    batches = [{7: range(200), 8: range(3), 9: [1]}, {7: [500], 9: [600], 5: [4]}]
    rows = []
    for b in batches:
        pairs = [(k, o) for k, own in b.items() for o in own]
        rows += sharing.rows_of_keys(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).to_pylist()
    got = {(r.doc_id, r.key, r.df) for r in sharing.shared(spark.createDataFrame(rows, sharing.SCHEMA)).collect()}
    assert got == {(o, 7, sharing.MANY) for o in [*range(200), 500]} | {(o, 8, 3) for o in range(3)} | {(1, 9, 2), (600, 9, 2)}


def test_token_files_round_trip(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file(tf.TOKENIZER))
    folder = f"file://{tmp_path}/tokens"
    got = tf.read_tokens(tf.token_files(docs, folder), folder).orderBy("doc_id").collect()
    start = 0
    for row, (i, text) in zip(got, rows, strict=True):
        want = coder.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (i, start, len(want), want)
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert tf.read_tokens(tf.token_files(empty, folder + "0"), folder + "0").count() == 0


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(5, "b"), (None, "a"), (5, "b b")], "doc_id long, text string")
    got = tf.read_tokens(tf.token_files(df, str(tmp_path)), str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (5, 2), (5, 4)]


def test_units_never_change_ids():
    from tokenizers import Tokenizer

    path = tokenizer_file(tf.TOKENIZER)
    coder, rnd = Tokenizer.from_file(path), random.Random(4)
    parts = ["a", "in", " ", "  ", "\n", "é", "日", "9", "'s", " ", " ", "　", "\u0085", "<|endoftext|>", "\r", "\x1c", "​", "Š"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    for i, j, data, offsets in flat_blocks(pa.array(texts)):
        ids, lengths = tf.encode_block(data, offsets, path)
        ends = np.cumsum(lengths)
        for k, text in enumerate(texts[i:j]):
            assert ids[ends[k] - lengths[k] : ends[k]].tolist() == coder.encode(text, add_special_tokens=False).ids + [0]


def test_units_are_encoded_once_per_worker(monkeypatch):
    path, encoded = tokenizer_file(tf.TOKENIZER), []
    whole = tf._encode_units

    def counting(data, starts, ends, *more):
        encoded.append([data.tobytes()[a:b] for a, b in zip(starts, ends)])
        return whole(data, starts, ends, *more)

    monkeypatch.setattr(tf, "_encode_units", counting)
    tf._known(path).clear()
    for texts in (["one two"], ["two two, (one two) two!!,"], ["two two,"]):
        for _, _, data, offsets in flat_blocks(pa.array(texts)):
            ids, _ = tf.encode_block(data, offsets, path)
            assert ids.tolist() == [i for t in texts for i in [*tf.tokenizer(path).encode(t, add_special_tokens=False).ids, 0]]
    assert [sorted(e) for e in encoded] == [[b" two", b"one"], sorted([b"two", b",", b" (one", b")", b"!!,"])]


def test_known_units_are_bounded_and_points_join_nothing():
    path = tokenizer_file(tf.TOKENIZER)
    known, most = tf._known(path), tf._known(path).most
    known.clear()
    known.most = 50
    rnd = random.Random(6)
    parts = ["a", "in", "9", " ", "\n", "é", "—", ",", ".", "!!", "'s", "don't", "<|endoftext|>", "<|endof", "|>", "_", "\x00", "\x7f"]
    try:
        for _ in range(60):
            texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(20)]
            for i, j, data, offsets in flat_blocks(pa.array(texts)):
                before = len(known.hashes)
                ids, _ = tf.encode_block(data, offsets, path)
                assert len(known.hashes) <= max(before, 50) + len(tf._units(data, offsets))
                want = [k for t in texts[i:j] for k in [*tf.tokenizer(path).encode(t, add_special_tokens=False).ids, 0]]
                assert ids.tolist() == want
        assert len(known.hashes) < 500
    finally:
        known.most = most
        known.clear()


def test_token_counts_are_greedy(docs, rows, empty):
    pieces = set(tc.pieces_of(tokenizer_file(tc.VOCABULARY)))
    longest = max(map(len, pieces))

    def greedy(w: bytes) -> int:
        w, i, n = b" " + w, 0, 0
        while i < len(w):
            i += next(k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in pieces)
            n += 1
        return n

    want = {}
    for i, text in rows:
        counts = [greedy(w) for w in brute.SPACE_WORD.findall(brute.raw(text))]
        want[i] = (len(counts), sum(counts), max(counts, default=0))
    assert _by_id(tc.token_counts(docs), "n_words", "n_tokens", "longest_word_tokens") == want
    assert tc.token_counts(empty).count() == 0


def test_sentencepiece_equals_library(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(sp.MODEL))
    want = {i: (library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows}
    assert _by_id(sp.encode(docs), "ids", "decoded") == want
    digests = {i: (len(a), brute.sha(",".join(map(str, a)).encode()), brute.sha(d.encode())) for i, (a, d) in want.items()}
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    assert _by_id(sp.encode(docs, columns), *columns) == digests
    assert sp.encode(empty, columns).count() == 0


def test_sentencepiece_random_strings():
    import sentencepiece

    path = tokenizer_file(sp.MODEL)
    library, mine, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sp.bpe(path), random.Random(8)
    parts = ["a", "b", "in", "er", " ", "  ", "\n", "th", "é", "日", "0", ".", "▁", "=", "aa", "ing", "lll", "\u0001"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(50))) for _ in range(2000)] + ["a" * 2000, "ha" * 700, "=-" * 300]
    for i, j, data, offsets in flat_blocks(pa.array(texts)):
        ids, ends = mine.encode(data, offsets)
        decoded = mine.decode_rows(ids, ends)
        for k, text in enumerate(texts[i:j]):
            want = library.encode(text)
            assert ids[ends[k] : ends[k + 1]].tolist() == want
            assert decoded[k] == library.decode(want)


ITEMS = [(1, "x1 th an er on x1 th an er on th an"), (2, "Only Three Words"), (3, None), (None, "a"), (10, "one two three four"), (10, "one two three four"), (7, "...")]


@pytest.mark.parametrize("limit", [64_000_000, 2])
def test_decontamination(spark, docs, rows, limit):
    more = [(1000, "so ONLY three, words!"), (1001, "x1 th an er on x1 th an er on th an er"), (1002, "only three wordsx")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("cleaned", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.decontaminate(df, items, max_bytes=limit)
    known = [x for x in ITEMS if x[0] is not None]
    assert _by_id(got, "n_words", "n_hit", "item_ids") == {i: brute.contamination(t, known) for i, t in rows + more}
    texts = _by_id(got, "cleaned")
    assert texts[1000] == ("so !",) and texts[1002] == ("only three wordsx",)
    assert dc.decontaminate(df, items.limit(0)).filter("n_hit > 0").count() == 0
    assert dc.decontaminate(df.limit(0), items, max_bytes=limit).count() == 0


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{SMALL[:-5]}0.01/documents.parquet")
    got = li.op4_language_id(spark, f"{SMALL[:-5]}0.01").join(table.select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = li.prototypes(li.learn(table, F.lit(True)))
    langs = [name for part, _ in model for name in part]
    result = _by_id(li.predict(docs, model), "lang_pred", "score")
    assert {result[i] for i in (0, 1, 2)} == {("und", 0.0)}
    assert all(0 <= s <= 1 and p in [*langs, "und"] for p, s in result.values())
    assert li.predict(empty, model).count() == 0
    nothing = li.prototypes(li.learn(docs, F.lit(True)))  # only null languages
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    # languages beyond one slice are scored in several passes, to the same result
    sliced = [(names[k : k + 1], matrix[k : k + 1]) for names, matrix in model for k in range(len(names))]
    again = _by_id(li.predict(docs, sliced), "lang_pred", "score")
    assert len(sliced) == 4 and all(again[i][0] == p and again[i][1] == pytest.approx(s) for i, (p, s) in result.items())


def test_language_vectors_of_many_letters():
    """A block with too many different letters for one number is split; rows keep their vectors."""
    texts = ["".join(chr(c) for c in range(0x4E00 + 3000 * k, 0x4E00 + 3000 * k + 3000)) for k in range(6)]
    import pyarrow

    (_, _, data, offsets), *_ = flat_blocks(pyarrow.array(texts))
    whole, _ = li.vectors(data, offsets, 16)
    letters = 1 << 21
    assert letters**3 >= 1 << 62  # no text has as many letters, so one row always fits
    for k in range(6):
        alone, _ = li.vectors(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], 16)
        assert (alone[0] == whole[k]).all()


def test_language_vectors_bundle_bound_grams():
    data = np.frombuffer("Ab c".encode(), np.uint8)
    got, has = li.vectors(data, np.array([0, 4]), 64)
    letter = lambda c: li._letter(ord(c), 64).astype(int)
    want = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(" ab c", "ab c ", "b c "))
    assert has[0] and got[0].astype(int).tolist() == want.tolist()


def test_quality_model(spark, docs, empty):
    folder = f"{SMALL[:-5]}0.01"
    got = qm.op9_quality_model(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95
    labels = spark.createDataFrame([(0, None), (None, 1), (5, 1), (5, 0), (6, 1), (7, 0), (20, 1)], "doc_id long, label int")
    model = qm.train(docs, labels, F.lit(True))
    scores = _by_id(qm.score(docs, model), "score")
    assert len(scores) == docs.count() and all(0 <= s[0] <= 1 for s in scores.values())
    assert qm.score(empty, model).count() == 0
    assert {round(r.score, 6) for r in qm.score(docs, qm.train(docs, labels.limit(0), F.lit(True))).collect()} == {1.0}
    kept = qm.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_model_learns_from_metadata(spark):
    rows = [(k, "same words here", "good" if k % 2 else "bad", None if k == 9 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, size long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, label int")
    model = qm.train(df, labels, F.lit(True), metadata=("label", "size"))
    got = _by_id(qm.score(df, model, ("label", "size")), "score")
    assert all((got[k][0] > 0.5) == bool(k % 2) for k in range(40))
    kept = qm.accepted(df, model, 0.5, ("label", "size"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(1, 40, 2))


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    size = qm.BUCKETS + qm.STATISTICS
    model = qm.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, qm.FACTORS)).astype(np.float32))
    ids, x = rng.permutation(size)[:9], rng.normal(size=9).astype(np.float32)
    raw, _ = model.raw(np.array([0, 4, 9]), ids, x)
    for (a, b), got in zip(((0, 4), (4, 9)), raw):
        pairs = sum(float(model.factors[ids[i]] @ model.factors[ids[j]]) * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert got == pytest.approx(0.3 + float(model.weights[ids[a:b]] @ x[a:b]) + pairs, rel=1e-4, abs=1e-4)


def test_quality_rules(docs, rows, empty):
    import re

    got = _by_id(qr.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text in rows:
        t = text or ""
        w = [x.decode() for x in brute.SPACE_WORD.findall(t.encode())]
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {x for x in wins if wins.count(x) > 1} if len(wins) < 1000 else {x for x, c in brute.Counter(wins).items() if c > 1}
        covered = {p for k, x in enumerate(wins) if x in often for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if brute.SPACE_WORD.search(x.encode())]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert got[i] == (*want, len(w) < 50 or 100 * len(covered) > 50 * len(w)), i
    assert qr.quality(empty).count() == 0


def test_line_rules(spark):
    prose = "Plain words of a long enough line that ends well. " * 12
    bad = "home | about | news | contact\nWOW!! BUY!! NOW!! it!!\n### $$$ %%% ***\nMenu\nAll rights reserved by us and you.\n"
    df = spark.createDataFrame([(1, prose + "\n" + bad + prose + "\n"), (2, bad * 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in qr.quality(df).collect()}
    assert got[1].cleaned == prose and not got[1].kept  # half of its words repeat a line
    assert got[2].cleaned == "" and got[2].words_left == 0 and not got[2].kept


def test_boilerplate_of_every_language(spark):
    """A line with a phrase of any language goes, in any case; without a table none goes for its phrases."""
    prose = "Ein Satz, der lang genug ist und gut endet. Une phrase assez longue qui finit bien. " * 4
    phrases = [p for some in qr.BOILERPLATE.values() for p in some]
    assert len(set(phrases)) == len(phrases) and all(p == p.lower() for p in phrases)
    df = spark.createDataFrame([(n, f"{prose}\nSome words, {p.upper()}, and more.") for n, p in enumerate(phrases)], "doc_id long, text string")
    assert {r.cleaned for r in qr.quality(df).collect()} == {prose}
    assert all(r.cleaned.endswith("and more.") for r in qr.quality(df, {}).collect())
    clean = spark.createDataFrame([(1, f"{prose}\nLes conditions étaient bonnes, la politique aussi, y volver a casa.")], "doc_id long, text string")
    assert "volver a casa." in qr.quality(clean).first().cleaned


def test_licence_scan(spark, docs, empty):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
        "The above copyright notice and this permission notice shall be included in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
    )
    texts = [
        "Words. Licensed under the Apache License, Version 2.0. More.", mit, "Licensed under CC BY-NC 4.0.\n" + mit.split("\n")[2],
        "You need a license to drive.", "SPDX-License-Identifier: BSD-3-Clause\nreleased under the MIT license", "plain", None,
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = ls.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert _by_id(got, "licences", "unused_ids", "n_unknown") == {
        0: (["Apache:2.0"], [], 0), 1: (["MIT"], [], 0), 2: (["CC:by-nc-4.0"], ["as_is"], 0), 3: ([], [], 1),
        4: (["SPDX:bsd-3-clause", "MIT"], [], 0), 5: ([], [], 0), 6: ([], [], 0), 7: (["GPL:general-3"], [], 0),
    }
    assert ls.licence_scan(docs).count() == docs.count() and ls.licence_scan(empty).count() == 0
    names = {n for n, _ in ls.SENTENCES}
    assert all(set(rule) <= names for _, rule in ls.RULES)
    cues = [c.decode().replace("-", " ") for c in ls.CUES]
    assert all(any(c in pattern for c in cues) for _, pattern in ls.SENTENCES), [p for _, p in ls.SENTENCES if not any(c in p for c in cues)]


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU General Public License
along with this program.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and
limitations under the License.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy was not distributed with this file, get one.
"""


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "dnl ", "C  "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_licence_texts_in_wrapped_lines(leader, end):
    want = {MIT_TEXT: "MIT", BSD_TEXT: "BSD-3-Clause", GPL_TEXT: "GPL-or-later:general-3", ISC_TEXT: "ISC", APACHE_TEXT: "Apache:2.0", MPL_TEXT: "MPL:2.0"}
    want[BSD_TEXT.replace(BSD_TEXT[BSD_TEXT.index("3. N") : BSD_TEXT.index("THIS S")], "")] = "BSD-2-Clause"
    want["Every file of this folder is dedicated to the public\ndomain."] = "public-domain"
    for text, licence in want.items():
        got = ls.scan(end.join(leader + line for line in text.split("\n")))
        assert (got["licences"], got["unused_ids"]) == ([licence], []), text
    assert ls.scan(APACHE_TEXT)["n_unknown"] == 1  # the address
    assert ls.scan(BSD_TEXT)["n_unknown"] == 0


@pytest.mark.parametrize("text, licence", [
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC:by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC:by-4.0"),
    ("Licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported licence.", "CC:by-nc-nd-3.0"),
    ("licensed under GPLv3", "GPL:general-3"), ("This library is under the LGPL-2.1.", "GPL:lesser-general-2.1"),
    ("Released under the AGPL v3.0 or later.", "GPL:affero-general-3.0"), ("License: MIT", "MIT"), ("Licence: Apache 2.0", "Apache:2.0"),
    ("license: BSD-3-Clause", "BSD:3-clause"), ("License: GPL-2.0-or-later", "GPL:general-2.0"), ("Distributed under the MIT license", "MIT"),
    ("Licensed under the BSD 3-Clause License", "BSD:3-clause"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache:2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL:general-3"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "GPL:lesser-general-2.1"),
    ("Mozilla Public License Version 2.0\n==================================", "MPL:2.0"),
])
def test_licences_of_usual_forms(text, licence):
    got = ls.scan(text)
    assert (got["licences"], got["unused_ids"]) == ([licence], [])


@pytest.mark.parametrize("text", [
    "the acc0unt was closed", "This is NOT licensed under the MIT license.", "It is not released under the GPLv3", "A driving license: mitigated by age.",
    "The file isn't available under the Apache License 2.0.",
])
def test_texts_that_name_no_licence_of_their_own(text):
    assert ls.scan(text)["licences"] == [] and ls.scan(text)["sentence_ids"] == []


def test_rules_equal_a_plain_matcher():
    assert [len(rule) for _, rule in ls.RULES] == sorted((len(rule) for _, rule in ls.RULES), reverse=True)
    rnd = random.Random(6)
    names = [n for n, _ in ls.SENTENCES]
    for _ in range(400):
        found = []
        while len(found) < 25:
            found += rnd.choice([rnd.choice(ls.RULES)[1], rnd.sample(names, 1), rnd.choice(ls.RULES)[1][:-1]])
        pairs = [(n, "") for n in found]
        assert ls.licences(pairs) == brute.licences(found, ls.RULES)


def test_licence_notices_of_one_line():
    """Lines without an end are no sentence of one notice."""
    got = ls.scan("Copyright 2020 A. Person\nReleased under the MIT License\nLicensed under CC BY 4.0\nYou need a license\n// SPDX-License-Identifier: ISC\nMore words")
    assert (got["licences"], got["n_unknown"]) == (["MIT", "CC:by-4.0", "SPDX:isc"], 2)
    assert ls.scan("Licensed under the GNU General Public License\n3 files")["licences"] == ["GPL:general"]
    assert ls.scan("Licensed under the GNU General Public License\nversion 3")["licences"] == ["GPL:general-3"]
    assert ls.scan("A Bar License that speaks of\na license in two lines.")["n_unknown"] == 1


@pytest.mark.parametrize("text, licence", [
    ("Licensed under the Apache License 2.0", "Apache:2.0"), ("Licensed under the Apache License.", "Apache"),
    ("This program is made available under the terms of the Eclipse Public License 2.0 which is here.", "EPL:2.0"),
    ("Released under the Eclipse Public License v1.0", "EPL:1.0"), ("released under the Mozilla Public License 2.0", "MPL:2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.", "Unlicense"),
    ("Dedicated to the Unlicense.", "Unlicense"), ("Licensed under the zlib license", "Zlib"), ("Released under the ISC License", "ISC"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\n"
     "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it.\n\n"
     "1. The origin of this software must not be misrepresented; you must not\n   claim it.\n2. Altered source versions must be plainly marked as such.\n"
     "3. This notice may not be removed or altered from any source distribution.", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL:1.0"),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software", "BSL"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "ISC"),
])
def test_licences_of_common_notices(text, licence):
    got = ls.scan(text)
    assert (got["licences"], got["unused_ids"], got["n_unknown"]) == ([licence], [], 0)
