"""Edge cases of the operators on tables of a few rows."""

import hashlib
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, brown_lm, components, langid, ordinal, packing, quality_rules, simhash, urlfilter, warc
from tessera.llm.common import row_ranges, text_bytes

LONG = "word " * 40_000
#: Nulls, empty and very long texts, ties and repeated rows, with columns whose names clash.
ROWS = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n ", "c", 3), (4, LONG, "d", 4), (5, "same text of five words", "e", 5), (6, "same text of five words", "f", 6), (6, "same text of five words", "f", 6), (None, "no id", "g", 7), (8, "\u00e9\u4e16\U0001f600 \x00", None, None)]
SCHEMA = "doc_id long, text string, fp string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

PER_ROW = {
    "langid": lambda df: langid.predict_languages(df, {"aa": b"abc def " * 100, "bb": b"xyz uvw " * 100}),
    "langid without samples": lambda df: langid.predict_languages(df, {}),
    "rules": quality_rules.repetition_rules,
    "simhash": lambda df: simhash.simhash_groups(df, words=4, size=1, max_bits=4),
    "simhash long": simhash.simhash_groups,
    "lm": lambda df: brown_lm.score_texts(df, brown_lm.train(df)),
    "bpe": lambda df: bpe.encode_texts(df, PATH, PATTERN, with_ids=True),
    "audio": lambda df: audio.audio_features(df, keep_media=True),
    "ordinal": lambda df: ordinal.grade_texts(df, ordinal.fit_classifier(df, df.select("doc_id", F.lit(1).alias("grade")).limit(2))),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_once(odd, empty, name):
    out = PER_ROW[name](odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    assert PER_ROW[name](empty).count() == 0


def test_pieces_cover_every_row(odd, empty):
    out = packing.pack_documents(odd, PATH, PATTERN).toPandas()
    assert set(out.doc_id.dropna()) == {1, 2, 3, 4, 5, 6, 8}
    assert out[out.doc_id == 1].length.tolist() == [1]
    assert (out[out.doc_id == 6].piece == 0).sum() == 2
    used = out.groupby("sequence_id").apply(lambda g: sorted(zip(g.offset, g.length, strict=True)), include_groups=False)
    for places in used:
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty, PATH, PATTERN).count() == 0


# packing


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=32))
@settings(max_examples=150, deadline=None)
def test_sweep_is_best_fit(counts):
    lengths = np.array([n for n, c in sorted(counts.items(), reverse=True) for _ in range(c)], dtype=np.int64)
    sequence, offset = packing.sweep(lengths, 32)
    for s in range(sequence.max(initial=-1) + 1):
        at = 0
        for o, n in sorted(zip(offset[sequence == s], lengths[sequence == s], strict=True)):
            assert o == at
            at += n
        assert 0 < at <= 32
    # the same number as best fit one by one, largest first
    free = []
    for n in lengths.tolist():
        fit = min((f for f in free if f >= n), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((32 if fit is None else fit) - n)
    assert sequence.max(initial=-1) + 1 == len(free)


@given(st.lists(st.booleans(), max_size=40))
@settings(max_examples=200, deadline=None)
def test_stack_match_as_by_a_stack(push):
    stack, pairs, short = [], [], []
    for i, p in enumerate(push):
        if p:
            stack.append(i)
        elif stack:
            pairs.append((i, stack.pop()))
        else:
            short.append(i)
    pops, taken, left, stays = packing.stack_match(np.array(push, dtype=bool))
    assert sorted(zip(pops.tolist(), taken.tolist(), strict=True)) == pairs and left.tolist() == short and stays.tolist() == stack


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((capacity if fit is None else fit) - n)
    return len(free)


@pytest.mark.parametrize("kind", ["mixed", "ties", "short beside long", "one length"])
def test_supersteps_over_many_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "RANGE_ROWS", 200)
    rng = np.random.default_rng(1)
    lengths = {
        "mixed": np.concatenate((rng.integers(1, 1025, 2000), np.full(900, 7))),
        "ties": rng.choice([1, 300, 341, 342, 511, 512, 513], 2500),
        "short beside long": np.concatenate((np.full(150, 520), rng.integers(1, 9, 2500))),
        "one length": np.full(1000, 60),
    }[kind]
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, 1024, "doc_id").toPandas()
    assert sorted(out.doc_id) == list(range(len(rows)))
    assert (out.set_index("doc_id").length.sort_index().to_numpy() == lengths).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum().shift(fill_value=0)).all() and g.length.sum() <= 1024
    # each range may leave a sequence open that a single sweep would have filled
    assert out.sequence_id.nunique() <= best_fit(lengths.tolist(), 1024) * 1.002 + 12


# WARC


def test_archive_round_trip_and_faults(spark):
    pages = spark.createDataFrame([(3, "http://a/", "x" * 200), (1, "http://b/", "x" * 200), (2, None, "x" * 200), (4, "http://c/", "y"), (5, "http://d/", "y"), (6, "http://e/", None), (7, "u", "\u00e9" * 60), (7, "u", "\u00e9" * 60)], "page_id long, url string, html string")
    out = {}
    for r in warc.round_trip(pages).select(warc.page_of(F.col("record_id")).alias("id"), "record_type", warc.page_of(F.col("refers_to")).alias("to"), "payload_bytes", "error").collect():
        assert r.error is None
        out.setdefault(r.id, []).append((r.record_type, r.to, r.payload_bytes))
    assert out == {1: [("response", None, 200)], 2: [("revisit", 1, 200)], 3: [("revisit", 1, 200)], 4: [("response", None, 1)], 5: [("response", None, 1)], 6: [("response", None, 0)], 7: [("response", None, 120)] * 2}
    assert warc.round_trip(pages.limit(0)).count() == 0

    good = warc.write_archives(warc.mark_revisits(pages)).first()
    content = bytes(good.content)
    broken = content[:-30]
    rows = spark.createDataFrame([("good", content), ("cut", broken), ("empty", b""), ("junk", b"not an archive")], "path string, content binary")
    got = warc.read_archives(rows).toPandas()
    assert got[got.path == "good"].error.isna().all()
    assert got[got.path == "cut"].error.notna().sum() == 1
    assert got[got.path == "junk"].error.notna().all() and len(got[got.path == "junk"]) == 1
    assert not len(got[got.path == "empty"])


@pytest.mark.parametrize(("change", "said"), [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "version"),
    (lambda r: re.sub(rb"(Content-Length: )(\d+)(\r\n\r\nHTTP)", rb"\g<1>9\g<2>\g<3>", r), "Content-Length"),
    (lambda r: r.replace(b"WARC-Date", b"X-Date"), "warc-date"),
    (lambda r: r.replace(b"hello", b"jello"), "digest"),
])
def test_records_are_validated(change, said):
    record = warc.build_record("response", warc.record_urn(5), "http://a/", b"hello", hashlib.sha256(b"hello").hexdigest(), "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"hello"
    with pytest.raises(ValueError, match=said):
        warc.parse_record(change(record))


@pytest.mark.parametrize("page_id", [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345])
def test_page_ids_in_record_ids(spark, page_id):
    urn = warc.record_urn(page_id)
    assert spark.range(1).select(warc.page_of(F.lit(urn))).first()[0] == page_id


# rules


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\x0b#\u00e9\u4e16\x85\xa0", max_size=40)), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_rules_as_by_brute_force(texts):
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    rows = []
    for a, b in row_ranges(offsets, 64):
        m = quality_rules.measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], (5,))
        rows += np.column_stack([m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).tolist()
    assert rows == [brute_rules(t) for t in texts]


# near-duplicates


@pytest.mark.parametrize(("minimum", "size", "n"), [(4, 3, 20), (4, 2, 7), (3, 2, 12), (2, 2, 28)])
def test_position_sets_cover(minimum, size, n):
    from itertools import combinations

    sets = [set(s) for s in simhash.position_sets(minimum, size)]
    assert len(sets) == n
    assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), minimum))


def test_long_lists_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    rows = [(bytearray(f.to_bytes(8, "big")), i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp binary, node long")
    want = {}
    values = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    want = {i: find(i) for i in range(len(fps)) if find(i) != i}
    for block in (7, 2048):
        links = simhash.similar_links(nodes, 1, 4, 4, simhash.position_sets(4, 3), block=block)
        assert {r.node: r.component for r in components.connected_components(links, "u", "v").collect()} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1200)}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = text.replace("w100 ", "other ")
    other = " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(9, text, "x"), (4, near, "y"), (7, text, "z"), (5, other, "x"), (None, text, "n")], "doc_id long, text string, component_id string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 4, 5]


# encoding


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoding_round_trip(texts):
    tool = bpe.encoder(PATH, PATTERN)
    for t, ids in zip(texts, tool.encode(texts), strict=True):
        assert tool.decode(ids) == t.encode()


@pytest.mark.parametrize("piece", ["a" * 3000, " " * 500, "thereintheonon" * 80, "\u00e9" * 70, "qwzx" * 33])
def test_long_pieces_as_short_ones(piece):
    ranks = bpe.vocabulary(PATH)
    data = piece.encode()
    width = 1 << (len(data) - 1).bit_length()
    assert bpe.encode_long(data, ranks) == bpe.encode_rows([data], width, ranks)[0]


# language models, classifier, audio, URLs


def test_lm_probabilities_add_up(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a b d", "a a b e f", None])], "doc_id long, text string")
    m = brown_lm.train(df, core_words=2, classes=2, frequent_words=3)
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    shares = np.bincount(m.word_class[: m.clustered], weights=m.word_counts[: m.clustered] / np.maximum(m.class_counts[m.word_class[: m.clustered]], 1))
    assert np.allclose(shares[shares > 0], 1)
    rest = [r.c for r in m.counts.collect() if bytes(r.word) not in m.words[: m.clustered]]
    assert (10 ** m.rest_log10(np.array([*rest, 0.0]))).sum() == pytest.approx(1)


def test_lm_as_by_direct_evaluation(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    side = lambda k: [words[int(x) * 2 + (k + j) % 2] for j, x in enumerate(rng.zipf(1.5, 12).clip(1, 14))]
    texts = [" ".join(side(i)) for i in range(60)] + ["", None, "never seen w3", "W4 w5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = brown_lm.train(df.where("doc_id < 50"), core_words=6, classes=3, least_count=3, frequent_words=25)
    runs = [[b"", *(t or "").encode().lower().split(), b""] for t in texts]
    counts = Counter(w for r in runs[:50] for w in r[1:])
    assert m.clustered > 8 and all(counts[w] >= 3 for w in m.words[1 : m.clustered])
    of = {w: int(m.word_class[i]) for i, w in enumerate(m.words[: m.clustered])}
    rest, k = int(m.word_class[m.clustered]), len(m.transition)
    # each word beyond the core has the class in which the core's class bigrams and its own are likeliest
    core = {w: of[w] for w in m.words[:7]}
    near = lambda w: core.get(w, rest)
    grid = np.zeros((k, k))
    for r in runs[:50]:
        for a, b in zip(r, r[1:], strict=False):
            grid[near(a), near(b)] += 1
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    for w in m.words[7 : m.clustered]:
        before, after = np.zeros(k), np.zeros(k)
        for r in runs[:50]:
            for i in range(1, len(r) - 1):
                if r[i] == w:
                    before[near(r[i - 1])] += 1
                    after[near(r[i + 1])] += 1
        gain = []
        for c in range(3):
            g = grid.copy()
            g[c] += after
            row = xlogx(g[c]).sum() - xlogx(g[c].sum()) - xlogx(grid[c]).sum() + xlogx(grid[c].sum())
            g = grid.copy()
            g[:, c] += before
            gain.append(row + xlogx(g[:, c]).sum() - xlogx(g[:, c].sum()) - xlogx(grid[:, c]).sum() + xlogx(grid[:, c].sum()))
        assert gain[of[w]] == pytest.approx(max(gain))
    grid = np.zeros((k, k))
    for r in runs[:50]:
        for a, b in zip(r, r[1:], strict=False):
            grid[of.get(a, rest), of.get(b, rest)] += 1
    share = (grid.sum(axis=0) + 1) / (grid.sum() + k)
    in_class = Counter()
    for w, c in of.items():
        in_class[c] += counts[w]
    others = [c for w, c in counts.items() if w not in of]
    want = {}
    for i, r in enumerate(runs):
        want[i] = 0.0
        for a, b in zip(r, r[1:], strict=False):
            ca, cb = of.get(a, rest), of.get(b, rest)
            p = (grid[ca, cb] + 5 * share[cb]) / (grid[ca].sum() + 5)
            e = counts[b] / in_class[cb] if b in of else max(counts[b] - 0.5, 0) / sum(others) + 0.5 * len(others) / sum(others) / (len(others) + 1)
            want[i] += np.log10(p * e)
    got = {r.doc_id: r.score for r in brown_lm.score_texts(df, m).collect()}
    assert got == pytest.approx(want)


def test_frequent_words_of_like_counts(spark):
    df = spark.createDataFrame([(f"u{i}".encode(), 1) for i in range(3000)] + [(b"often", 9), (b"", 4)], "word binary, c long")
    words, known = brown_lm.most_frequent(df, 1000)
    assert words[0] == b"often" and known[0] == 9 and 800 < len(words) < 1200
    assert len(brown_lm.most_frequent(df, 10_000)[0]) == 3001


def test_exchange_separates_two_vocabularies():
    b = np.zeros((9, 9), dtype=np.int64)
    rng = np.random.default_rng(0)
    for _ in range(4000):
        side = rng.integers(2)
        b[1 + 4 * side + rng.integers(4) - (rng.integers(4) == 9), 1 + 4 * side + rng.integers(4) if side == 0 else 5 + rng.integers(4)] += 1
    cls = brown_lm.exchange(b, [0], 2, 10)
    assert len(set(cls[1:5])) == 1 and len(set(cls[5:9])) == 1 and cls[1] != cls[5]


def test_classifier_orders_grades(spark):
    rows = [(i, f"{['bad', 'plain', 'good'][i % 3]} filler text number {i}", i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal.fit_classifier(df, df.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = ordinal.grade_texts(df, model).join(df.select("doc_id", "grade"), "doc_id").groupBy("grade").agg(F.avg("expected_grade").alias("e"), F.avg(F.col("selected").cast("int")).alias("s")).orderBy("grade").collect()
    assert [round(r.e) for r in got] == [0, 1, 2] and [round(r.s) for r in got] == [0, 0, 1]
    kept = ordinal.keep_texts(df, model)
    assert kept.columns == df.columns and {r.grade for r in kept.collect()} == {2}


def test_clips():
    for data in (b"", b"a", b"a" * 191, b"a" * 192, b"a" * 193, bytes(range(256)) * 40):
        payload = audio.pad_payload(data)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data)
        media = audio.encode_wav(payload)
        assert audio.decode_wav(media) == (payload, audio.RATE)
        tensor, _ = audio.features(payload)
        assert tensor.shape == (audio.FRAMES, audio.MELS) and np.isfinite(tensor).all()
    with pytest.raises(ValueError):
        audio.decode_wav(media[:-1])
    quiet, loud = np.full(4000, 128, np.uint8), (128 + 100 * np.sin(np.arange(2000))).astype(np.uint8)
    _, spans = audio.features(bytes(np.concatenate((quiet, loud, quiet))))
    assert len(spans) == 1 and spans[0][0] == pytest.approx(0.5, abs=0.05) and spans[0][1] == pytest.approx(0.75, abs=0.05)
    column = pa.array([np.zeros(audio.FRAMES * audio.MELS, np.float32)] * 3, pa.list_(pa.float32()))
    assert audio.tensor_array(column).to_numpy_ndarray().shape == (3, audio.FRAMES, audio.MELS)


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Spam.NET:80/x/index.html?utm_source=a&q=1#f", "https://spam.net/x?q=1", "http://sub.example.net/en/1", "http://example.net", "http://a.org/fr/1", "http://notexample.com/de/1", "http://example.com/de/1", "a://b\n/c"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    listed = spark.createDataFrame([("http://a.org/fr/1",), ("x://notexample.com/de/1/",), (None,)], "u string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, rules, listed).collect()}
    assert len(got) == len(urls)
    assert [got[i].host for i in (0, 1, 2, 3)] == [""] * 4
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("www.spam.net:80", "/x/index.html", None, "allow")
    assert got[4].canonical == got[5].canonical == "spam.net/x?q=1"
    assert [(got[i].rule, got[i].verdict) for i in range(5, 11)] == [("net/", "block"), ("example.net/en/", "allow"), (None, "allow"), ("org/fr/", "allow"), (None, "block"), ("example.com/de/", "block")]
    assert got[11].host == "b\n" or got[11].host == "b"
    assert urlfilter.filter_urls(df, rules, listed.limit(0)).where("listed").count() == 0


def test_urls_with_clashing_columns_and_a_long_list(spark):
    names = ("rule_verdict", "__listed_url", "__possible", "canonical", "host")
    df = spark.createDataFrame([(i, f"http://a.com/{i}", *["own"] * 5) for i in range(60)], "page_id long, url string, " + ", ".join(f"{n} string" for n in names))
    listed = df.where("page_id % 3 = 0").select("url")
    for most in (0, 1000):
        got = urlfilter.filter_urls(df, (), listed, broadcast_rows=most)
        rows = got.collect()
        assert len(rows) == 60 and all((r.rule_verdict, r["__listed_url"], r["__possible"]) == ("own",) * 3 for r in rows)
        assert {r.page_id for r in rows if r.verdict == "block"} == set(range(0, 60, 3))
        assert {r.canonical for r in rows} == {f"a.com/{i}" for i in range(60)} and {r.host for r in rows} == {"a.com"}


def test_every_language_is_learned(spark):
    rows = [(f"l{k}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}x" for w in "abcdefghij" * (2000 if k == 3 else 6)), k) for k in range(80)]
    df = spark.createDataFrame([(l, t + " " + "q" * i) for l, t, _ in rows for i in range(3)] + [(None, "x"), ("zz", None), ("yy", "12 34")], "lang string, text string")
    got = langid.sample_texts(df, "text", "lang", 2)
    assert set(got) == {f"l{k}" for k in range(80)}
    assert len(got["l3"]) > 100_000


def test_every_grade_and_length_is_fitted(spark):
    df = spark.createDataFrame([(i, f"grade{i % 20} " * (12_000 if i % 20 == 7 else 3), i % 20) for i in range(200)], "doc_id long, text string, grade int")
    model = ordinal.fit_classifier(df, df.select("doc_id", "grade"), per_grade=5)
    assert model.grades == tuple(map(float, range(20)))
    y, cuts, _, counts = ordinal.training_sample(df.union(df), df, "doc_id", "text", "grade", 5)
    assert sorted(y) == sorted(list(range(20)) * 5) and len(cuts) == 101 and set(counts.values()) == {10}


def test_gradient_of_the_ordinal_fit():
    # the fitted loss is at a minimum in every direction tried by finite differences
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (300, 4))
    level = np.clip((x @ [2, -1, 1, 0] + rng.normal(0, 1, 300) + 1).astype(int), 0, 2)
    rows, cols = np.nonzero(x)
    cuts = np.concatenate(([0], np.cumsum(x.sum(axis=1))))
    model = ordinal.fit(level.astype(float), cuts, cols, {0.0: 100, 1.0: 100, 2.0: 100}, rounds=4000, rate=0.5, l1=0.0, least=1, z=0.0)
    seen = np.bincount(level, minlength=3)

    def loss(w, theta):
        tail = np.column_stack((np.ones(300), 1 / (1 + np.exp(theta[None, :] - (x @ w)[:, None])), np.zeros(300)))
        p = tail[np.arange(300), level] - tail[np.arange(300), level + 1]
        return -(np.log(p) / seen[level] / 3).sum()

    w, theta = model.weights[:4].copy(), model.thresholds.copy()
    for array in (w, theta):
        for k in range(len(array)):
            array[k] += 1e-4
            up = loss(w, theta)
            array[k] -= 2e-4
            down = loss(w, theta)
            array[k] += 1e-4
            assert abs(up - down) / 2e-4 < 2e-3


def test_bloom_never_misses(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), F.col("id")).alias("u"))
    words = urlfilter.build_filter(listed, "u")
    both = spark.range(20_000).select("id", F.concat(F.lit("h/"), F.col("id")).alias("u"))
    hits = both.where(urlfilter.possibly_listed(both, "u", words))
    assert hits.where("id < 5000").count() == 5000
    assert hits.where("id >= 5000").count() < 150


def archive_of(payloads, **options):
    writer = warc.ArchiveWriter("x", **{"archive_bytes": 1 << 40, "dict_bytes": 4096, "sample_bytes": 1 << 18, "level": 3} | options)
    for i, p in enumerate(payloads):
        writer.add(warc.build_record("response", warc.record_urn(i), "http://a/", p, hashlib.sha256(p).hexdigest(), "2024-01-01T00:00:00Z"))
    return writer.close()[1]


def test_reading_time_is_linear_in_the_archive():
    rng = np.random.default_rng(3)
    content = archive_of(rng.bytes(700) for _ in range(20_000))
    frames = content[content.index(b"\x28\xb5\x2f\xfd", 4096) :]
    head = content[: len(content) - len(frames)]
    seconds = []
    for times in (1, 8):
        began = time.perf_counter()
        assert sum(isinstance(x, bytes) for x in warc.read_archive(head + frames * times)) >= 19_000 * times
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * 4 * seconds[0]


def test_broken_dictionaries_and_frames_are_errors():
    content = archive_of([b"hello world %d" % i for i in range(50)])
    n = struct.unpack_from("<I", content, 4)[0]
    frames = content[8 + n :]
    leading = lambda body: struct.pack("<II", warc.SKIPPABLE_MAGIC, len(body)) + body
    plain = content[8 : 8 + n]
    for body in (struct.pack("<I", 0xEC30A437) + b"x" * 40, struct.pack("<I", warc.FRAME_MAGIC) + b"x" * 40, zstd.compress(plain)[:-3]):
        got = list(warc.read_archive(leading(body) + frames))
        assert len(got) == 1 and got[0].startswith("dictionary")
    assert len([x for x in warc.read_archive(leading(zstd.compress(plain)) + frames) if isinstance(x, bytes)]) == 50
    # a broken frame hides no other one; skippable frames may stand between
    second = warc.frame_end(frames, 0)
    broken = bytearray(frames)
    broken[second - 6] ^= 0xFF
    got = list(warc.read_archive(leading(plain) + bytes(broken[:second]) + warc.EMPTY_FRAME.encode() + bytes(broken[second:])))
    assert isinstance(got[0], str) and all(isinstance(x, bytes) for x in got[1:]) and len(got) == 50
    assert [isinstance(x, str) for x in warc.read_archive(frames[: second - 9])] == [True]


def test_archives_are_objects(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} é " * 40) for i in range(300)], "page_id long, url string, html string").repartition(3)
    warc.save_archives(warc.write_archives(warc.mark_revisits(pages), archive_bytes=4000, sample_bytes=2000), str(tmp_path / "warc"))
    files = [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part-")]
    assert len(files) > 3
    records = [r for p in files for r in warc.read_archive(p.read_bytes())]
    assert len(records) == 300 and all(b"WARC/1.1" in r[:9] for r in records)


def thue_morse(n):
    return bytes(b"ab"[bin(i).count("1") & 1] for i in range(n))


def test_rules_where_hashes_collide():
    one = thue_morse(2048)
    two = bytes(b"ab"[c == 97] for c in one)
    text = (one + b"\n" + two).decode()
    words = text.replace("\n", " ")
    for t in (text, f"{words} x y {words}", " ".join([words] * 3)):
        raw, offsets = text_bytes(pa.array([t, "b a"], pa.string()))
        m = quality_rules.measure(raw, offsets, (5,))
        assert [m[c][0] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_rules(t)


@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_rules_without_any_hash(texts):
    # every hash the same: only the comparison of contents tells
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_rules, "mix", lambda h: np.zeros_like(h))
        m = quality_rules.measure(raw, offsets, (5,))
    assert np.column_stack([m[c] for c in names]).tolist() == [brute_rules(t) for t in texts]


def test_features_against_a_plain_transform():
    rng = np.random.default_rng(4)
    samples = bytes(rng.integers(0, 256, 3000, dtype=np.uint8))
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    x = x - x.mean()
    # resampling: each output sample straight from the interpolating filter, tap by tap
    n_taps, up, down = audio.TAPS * audio.UP, audio.UP, audio.DOWN
    t = np.arange(n_taps) - (n_taps - 1) / 2
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(n_taps)
    y = []
    for k in range(len(x) * up // down):
        at, phase = divmod(k * down, up)
        taps = h[phase::up]
        taps = taps / taps.sum()
        y.append(sum(taps[j] * (x[i] if 0 <= (i := at + audio.TAPS // 2 - 1 - j) < len(x) else 0.0) for j in range(audio.TAPS)))
    y = np.array(y)
    assert audio.resample(x.astype(np.float32)) == pytest.approx(y, abs=1e-4)
    frames = [y[i : i + audio.WINDOW] * np.hanning(audio.WINDOW) for i in range(0, len(y) - audio.WINDOW + 1, audio.HOP)]
    k, i = np.arange(audio.WINDOW // 2 + 1)[:, None], np.arange(audio.WINDOW)[None, :]
    power = np.array([np.abs((f[None, :] * np.exp(-2j * np.pi * k * i / audio.WINDOW)).sum(axis=1)) ** 2 for f in frames])
    mel = np.log10(power @ audio.mel_bank() + 1e-6)
    edges = np.linspace(0, len(mel), audio.FRAMES + 1).astype(int)
    want = np.stack([mel[a : max(b, a + 1)].mean(axis=0) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    got, _ = audio.features(samples)
    assert got == pytest.approx(want, abs=0.02)


def test_sizes_by_plain_compression(spark):
    samples = {"aa": b"abc def ghi jkl " * 200, "bb": b"xyz uvw rst opq " * 200}
    texts = ["abc def " * 100, "xyz abc uvw " * 400, "opq", "Rst, uvw!"]
    got = {r.doc_id: r for r in langid.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples).collect()}
    for i, t in enumerate(texts):
        data = langid.letters(t)
        sizes = {}
        for name, sample in samples.items():
            packer = langid.Packer(sample, 1500)
            if len(data) < langid.SHORT:
                sizes[name] = len(packer.tool.compress(packer.context + data)) - len(packer.tool.compress(packer.context))
            else:
                sizes[name] = sum(len(packer.tool.compress(data[a : a + 2048])) for a in range(0, len(data), 2048))
        best = min(sizes, key=lambda k: (max(1, sizes[k]), k))
        assert got[i].lang_best == best


def test_ids_have_to_be_numbers(spark):
    with pytest.raises(TypeError):
        simhash.simhash_groups(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
