"""The pipeline's near-duplicates against brute force over the sets of five-word shingles."""

import random

import numpy as np

from tessera.llm import simhash

WORDS = 204


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pair(rng, replaced):
    """A text of words of its own, and a copy with ``replaced`` other words in a row."""
    words = [f"w{rng.getrandbits(48)}" for _ in range(WORDS)]
    other = [f"w{rng.getrandbits(48)}" for _ in range(replaced)]
    return " ".join(words), " ".join(words[:-replaced] + other)


def dropped(spark, pairs):
    """Which pairs lose their second text."""
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    return [2 * i + 1 not in kept for i in range(len(pairs))]


def test_isolated_pairs_as_by_brute_force(spark):
    rng = random.Random(8)
    pairs = [pair(rng, m) for m in [22] * 60 + list(range(17, 36)) * 4]
    want = [similarity(a, b) >= 0.8 for a, b in pairs]
    assert sum(want) >= 80 and len(want) - sum(want) >= 50
    assert dropped(spark, pairs) == want


def test_repeated_passages(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(30):
        words = [f"w{rng.getrandbits(48)}" for _ in range(400)]
        passage = words[100:130]
        pairs.append((" ".join(words), " ".join(words[:130] + passage * 3 + words[130:])))
    assert min(similarity(a, b) for a, b in pairs) > 0.9
    assert all(dropped(spark, pairs))


def test_a_chain_is_one_group_and_a_hub_links_nothing_by_itself(spark):
    rng = random.Random(10)
    word = lambda: f"w{rng.getrandbits(48)}"
    base = [word() for _ in range(WORDS)]
    # each text is near to the next; the ends aren't near to each other
    chain = [" ".join([word() if k < 15 * i else w for k, w in enumerate(base)]) for i in range(1)]
    now = base
    for i in range(1, 6):
        now = [word() if 15 * (i - 1) <= k < 15 * i else w for k, w in enumerate(now)]
        chain.append(" ".join(now))
    # two texts near to each other, each at about 0.7 to the least id of their lists
    hub = [word() for _ in range(WORDS)]
    side = hub[:-34] + [word() for _ in range(34)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(10, " ".join(hub)), (11, " ".join(side)), (12, " ".join([*side[:-5], *(word() for _ in range(5))]))]
    assert similarity(rows[0][1], rows[5][1]) < 0.8 <= min(similarity(rows[i][1], rows[i + 1][1]) for i in range(5))
    assert similarity(rows[6][1], rows[7][1]) < 0.8 > similarity(rows[6][1], rows[8][1])
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(6), 0) | {10: 10, 11: 11, 12: 11}


def test_group_links_span_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(0, 1 << 40, 40)
        sets = []
        for _ in range(rng.integers(2, 25)):
            x = base.copy()
            x[: rng.integers(0, 12)] = rng.integers(0, 1 << 40)
            sets.append(np.unique(np.concatenate((x[rng.random(40) < 0.97], rng.integers(0, 1 << 40, rng.integers(0, 4))))).astype(np.uint64))
        sets += [np.empty(0, np.uint64)] * int(rng.integers(0, 3))
        n = len(sets)

        def components(links):
            root = list(range(n))
            for a, b in links:
                old, new = root[b], root[a]
                root = [new if r == old else r for r in root]
            return {frozenset(i for i in range(n) if root[i] == r) for r in root}

        def jaccard(a, b):
            common = len(np.intersect1d(a, b))
            return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0

        got = simhash.group_links(sets, 0.8)
        assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
        assert len(got) < n
        assert components(got) == components([(a, b) for a in range(n) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])


def test_long_groups_in_blocks(spark):
    rng = random.Random(11)
    pairs = [pair(rng, 20) for _ in range(3)]
    base = pairs[0][0].split()
    texts = [t for p in pairs for t in p]
    # a group of texts at 0.6 to 0.8 of each other, in which only some pairs are near
    for k in range(30):
        words = base[:]
        for i in range(k % 10, 204, 14):
            words[i] = f"x{k % 10}"
        if k >= 10:
            words[-k:] = [f"y{k}_{i}" for i in range(k)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    for block in (8, 2048):
        got = {r.doc_id: r.component_id for r in simhash.simhash_groups(df, block=block).collect()}
        assert got == dict(enumerate(root))
