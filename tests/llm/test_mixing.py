from collections import Counter, defaultdict

import pytest

from lamella.llm import mixing

from .conftest import prose


def fill(sizes, weights, share, epochs):
    """Targets by repeated clamping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize(("weights", "share", "epochs"), [((3, 1, 2), 1.5, 2.0), ((1,), 0.4, 1.0), ((5, 1), 2.5, 3.0)])
def test_targets_and_taken(docs, weights, share, epochs):
    rows = [(i, prose(i, 1 + i * 7 % 50), None, None if i % 31 == 0 else "s%d" % (i % 7 if i % 2 else 0)) for i in range(600)]
    got = mixing.mix(docs(*rows), weights=weights, share=share, max_epochs=epochs).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want = fill(dict(sizes), weights, share, epochs)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= epochs * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs(*rows, parts=5), weights=weights, share=share, max_epochs=epochs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_messy_and_empty(messy, empty):
    got = mixing.mix(messy).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in messy.collect())
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"] in (2, 3, 4, 5, 9)} == {2: 0, 3: 0, 4: 0, 5: 30_000, 9: 1}
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty).collect() == []
    assert mixing.repeat(empty, mixing.marks(empty)).collect() == []


def test_texts_without_words(docs):
    got = mixing.mix(docs((1, "", None, "a"), (2, None, None, "b"))).collect()
    assert [r["taken"] for r in got] == [0, 0] and [r["target"] for r in got] == [0.0, 0.0]


def test_repeat_follows_mix(docs, messy):
    rows = [(i, prose(i, 5 + i % 40), None, "s%d" % (i % 5)) for i in range(200)]
    df = docs(*rows)
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()})
    repeated = mixing.repeat(df, mixing.marks(df))
    assert repeated.columns == df.columns
    assert Counter(r["doc_id"] for r in repeated.collect()) == +want
    assert mixing.repeat(messy, mixing.marks(messy)).columns == messy.columns


def test_repeat_keeps_any_column(docs, spark):
    df = docs((1, "a b", None, "s"), (2, "c d e", None, "s")).selectExpr("*", "7 as __copy", "8 as whole", "9 as last", "'x' as `a.b`", "3 as row")
    got = mixing.repeat(df, mixing.marks(df))
    assert got.columns == df.columns and {r["__copy"] for r in got.collect()} == {7}


def test_rows_without_an_id_are_spread(docs):
    """Rows of no or one id have places of their own, so no range holds them all."""
    rows = [(None if i % 2 else 5, prose(i, 12), None, "s") for i in range(400)]
    places = mixing.sizes(docs(*rows), 17).selectExpr("substring(draw, 1, 1) as range").groupBy("range").count().collect()
    assert len(places) == 16 and max(r["count"] for r in places) < 60
    got = mixing.mix(docs(*rows), weights=(1.0,), share=0.5, max_epochs=2.0).collect()
    assert abs(sum(r["taken"] for r in got) - 2400) <= 6
