import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import jaccard
from lamella.llm.components import components

from .conftest import prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, num, den):
    """(doc_id, n, component) of every row; rows with a null id tie nothing together."""
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def copies(seed, n):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = prose(seed * 1000 + g, rng.choice([1, 3, 6, 12, 40, 150, 400])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 25, len(words) // 12])):
                own[rng.randrange(len(own))] = "z%d" % rng.randrange(10**6)
            cut = rng.choice([0, 0, len(own) // 10])
            rows.append((len(rows) * 3 + 1, " ".join(own[: len(own) - cut])))
    line = prose(99, 30)
    rows += [(10**6 + i, f"{line}\n{prose(500 + i, 120)}\n{prose(7, 60)}") for i in range(25)]
    rng.shuffle(rows)
    return rows


def found(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (3, 60, 100, 3), (2, 1, 1, 4)])
def test_equals_brute_force(docs, k, num, den, seed):
    rows = copies(seed, 60)
    assert found(jaccard.link_components(docs(*rows), k, num, den)) == brute(rows, k, num, den)


def test_tiles_of_split_clusters(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 11)
    rows = copies(5, 12)
    words = prose(77, 150).split()
    for i in range(40):
        own = list(words)
        own[3 * i + 1] = f"new{i}"
        rows.append((5000 + i, " ".join(own[: 150 - i // 2])))
    assert found(jaccard.link_components(docs(*rows), 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_messy_and_empty(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(jaccard.link_components(messy, 4, 85, 100)) == brute(rows, 4, 85, 100)
    assert found(jaccard.link_components(empty)) == Counter()


def test_two_texts_of_one_id(docs):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, prose(3, 60))]
    assert {t[2] for t in found(jaccard.link_components(docs(*rows), 4, 85, 100)) if t[0] in (7, 8)} == {5}


def test_linked_sets_share_enough_keys():
    rng = np.random.default_rng(1)
    sets = jaccard.Sets(4, 80, 100)
    for n in (1, 2, 3, 5, 8, 13, 40, 100, 333, 1000, 4000):
        for _ in range(20):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            left = int(rng.integers(0, n // 4 + 1))
            right = rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)
            x, y = np.unique(both), np.unique(np.concatenate((both[left:], right)))
            same, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if not len(y) or 100 * same < 80 * union:
                continue
            shared = [(len(np.intersect1d(a, b)), ca, cb) for a, ca in sets.keys(x) for b, cb in sets.keys(y)]
            assert any(s >= max(ca, cb) > 0 for s, ca, cb in shared)


def test_linked_small_sets_keep_a_key_in_common():
    """The rarest keys of two linked sets meet at every small size, whatever else is there."""
    rng = np.random.default_rng(5)

    def kept(own, often):
        out = set()
        for keys, common in own:
            shared = sorted((often[k], k) for k in keys.tolist() if often[k] > 1)
            out.update(k for _, k in shared[: max(0, len(shared) - common + 1)])
        return out

    for num, others in ((80, 0), (80, 12), (85, 0), (60, 3)):
        sets = jaccard.Sets(4, num, 100)
        crowd = [sets.keys(rng.integers(0, 2**64, int(rng.integers(3, 14)), dtype=np.uint64)) for _ in range(others)]
        base = Counter(k for own in crowd for keys, _ in own for k in keys.tolist())
        for n in range(1, 31):
            for _ in range(15):
                x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
                for less in range(n - sets.least(n) + 1):
                    y = np.sort(rng.choice(x, n - less, replace=False))
                    own = sets.keys(x), sets.keys(y)
                    often = base + Counter(k for o in own for keys, _ in o for k in keys.tolist())
                    assert kept(own[0], often) & kept(own[1], often), (num, others, n, less)


def test_bitmap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    found = [np.unique(rng.integers(0, 3000, int(rng.integers(1, 900)), dtype=np.uint64)) for _ in range(30)]
    links = jaccard.tile_links(found, 20, 100, 0)
    root = list(range(30))

    def top(i):
        return i if root[i] == i else top(root[i])

    for a, b in links:
        root[top(a)] = top(b)
    for a in range(30):
        for b in range(a):
            same = len(np.intersect1d(found[a], found[b]))
            if 100 * same >= 20 * (len(found[a]) + len(found[b]) - same):
                assert top(a) == top(b)


def test_short_texts_are_whole_sequences():
    sets = jaccard.Sets(4, 85, 100).of(pa.array(["a b c", "A b  C", "a b", "", "a b c a", "a a a a a"], pa.large_string()))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 1]
    assert sets[0] == sets[1] and sets[0] != sets[2] and sets[0] != sets[4]


@pytest.mark.parametrize("edges", [[(i + 1, i) for i in range(300)], [(i, i // 2) for i in range(1, 200)], [(7, j) for j in range(8, 400)], [], [(5, 5)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    low = min(nodes, default=None)
    assert {**got, **({low: low} if nodes else {})} == {x: low for x in nodes}


def test_components_of_random_graph(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_an_id_with_several_texts_is_one_node(docs):
    a, b = prose(1, 60), prose(2, 60)
    words = a.split()
    for second in (a, " ".join([*words[:30], "changed", *words[31:]])):
        rows = [(5, a), (8, second), (8, b), (3, b + " x"), (3, None), (9, prose(3, 60)), (11, prose(4, 50)), (11, ""), (11, prose(5, 50))]
        got = found(jaccard.link_components(docs(*rows), 4, 85, 100))
        assert got == brute(rows, 4, 85, 100)
        assert {t[2] for t in got if t[0] in (3, 5, 8)} == {3}


def test_hot_keys_are_dealt_by_set(docs, monkeypatch):
    """A passage in every document, and a group of near copies, whose keys are over the bound."""
    monkeypatch.setattr(jaccard, "HOT_POSTINGS", 20)
    monkeypatch.setattr(jaccard, "MOST_HOT", 10**9)
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 200)
    line, words = prose(99, 6), prose(77, 90).split()
    rows = [(i, f"{line}\n{prose(500 + i, 8 + i)}") for i in range(60)]
    for i in range(60):
        own = list(words)
        own[i + 1] = f"new{i}"
        rows.append((5000 + i, " ".join(own)))
    df = docs(*rows)
    sets = jaccard.Sets(4, 85, 100)
    postings = jaccard.sketch(df, sets).where("keys is not null")
    assert len(jaccard.hot_keys(postings, 10**4)[0])
    assert found(jaccard.link_components(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_keep_one_treats_texts_of_one_id_apart(docs):
    t, u = prose(1, 40), prose(2, 40)
    df = docs((5, t), (8, t), (8, u), (8, u), (8, u.upper()), (9, t + " x"), (None, t), (4, ""), (4, ""), (4, None))
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in jaccard.keep_one(df).collect()) == Counter({(5, t): 1, (8, u): 1, (None, t): 1, (4, ""): 2})
    plain = docs((5, t), (8, t), (9, u), (None, u), (4, ""), (3, None))
    assert Counter(r["doc_id"] for r in jaccard.keep_one(plain).collect()) == Counter({5: 1, 9: 1, None: 1, 4: 1, 3: 1})


def test_sets_are_told_by_two_hashes():
    found = [np.array(v, np.uint64) for v in ([], [1], [1, 2], [2], [], [3, 5, 9])]
    refs, checks = jaccard.identities(found)
    assert refs[0] == refs[4] == checks[0] == 0
    assert len(set(refs.tolist())) == len(set(checks.tolist())) == 5
    alone = [jaccard.identities([s]) for s in found]
    assert refs.tolist() == [a[0][0] for a in alone] and checks.tolist() == [a[1][0] for a in alone]


def test_sizes_of_neighbouring_bands_meet(docs, monkeypatch):
    """Near copies whose sizes lie on both sides of a band's edge, in blocks of few sets."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rows = []
    for g, size in enumerate((11, 34, 50, 72, 147)):
        words = prose(900 + g, size + 8).split()
        rows += [(100 * g + i, " ".join(words[: size + i])) for i in range(8)]
    sets = jaccard.Sets(4, 60, 100)
    assert all(len({jaccard.floor(jaccard.log(len(s)) / -jaccard.log(jaccard.BAND_RATIO)) for s in sets.of(pa.array([t for i, t in rows if i // 100 == g], pa.large_string()))}) > 1 for g in range(5))
    assert found(jaccard.link_components(docs(*rows), 4, 60, 100)) == brute(rows, 4, 60, 100)
