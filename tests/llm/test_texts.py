"""Token counts, licence scans and fingerprints against brute force."""

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from lamella.llm import fingerprints, licenses, tokencount

from .conftest import prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in vocabulary:
                at += size
                n += 1
                break
        else:
            return 1
    return n


@pytest.mark.parametrize("vocabulary", [{"a", "ab", "abcd", "b", "c", "cd", "bcde"}, {"ab", "abc", "d"}, {"a", "aa", "aaaa", "ba"}])
def test_automaton_is_greedy(vocabulary):
    import itertools

    automaton = tokencount.Automaton(vocabulary)
    for n in range(7):
        for w in itertools.product("abcde"[: 5 if n < 5 else 3], repeat=n):
            assert automaton.length("".join(w)) == (greedy("".join(w), vocabulary, 4) if n else 0)


def test_token_counts(docs, messy, empty):
    pieces = set(tokencount.piece_vocabulary(MODEL))
    longest = max(map(len, pieces))

    def want(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return len(words), sum(greedy("▁" + w, pieces, longest) for w in words)

    for df in (docs(*[(i, prose(i, i % 40) + " Hello world, naïve ▁x 日本") for i in range(80)]), messy):
        got = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(df, MODEL).collect())))
        assert got == sorted(map(repr, ((r["doc_id"], *want(r["text"])) for r in df.collect())))
    assert tokencount.token_counts(empty, MODEL).collect() == []


def body(name):
    return next(text for known, _, text in licenses.KNOWN if known == name)


def test_licenses(docs, messy, empty):
    mit = "MIT License\n" + body("MIT")
    texts = [mit, "Copyright (c) 2020 Someone\ncopyright 2021 Else\n\n" + mit.upper(), mit.replace(",", " ;").replace(". ", ".\n\n"), mit + " extra", mit[:-60], "all RIGHTS reserved", "Released under the MIT Licence!", "", None, "(c) X", "copyrighted matter"]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs(*enumerate(texts))).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: "notice-reserved", 6: "notice-MIT", 7: None, 8: None, 9: None, 10: None}
    assert len({r["digest"] for r in licenses.scan(docs((1, "The Licence licence, favours"), (2, "the LICENSE license favours"), (3, "the license  licence favours."))).collect()}) == 1
    assert licenses.scan(messy).count() == messy.count() and licenses.scan(empty).collect() == []


def test_every_known_text_hits(docs):
    """Each with each title and a copyright line, wrapped at some width, in capitals."""
    import textwrap

    known = licenses.texts()
    assert len({name for name, _ in known}) >= 15
    own = [(name, "Copyright (c) 2024 Some One and others\n" + textwrap.fill(text, 40 + i % 37)) for i, (name, text) in enumerate(known)] + [(name, text.upper()) for name, text in known]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs(*((i, t) for i, (_, t) in enumerate(own)))).collect()}
    assert got == {i: name for i, (name, _) in enumerate(own)}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files")
def test_long_licenses_hit(docs):
    folder = "/usr/share/common-licenses/"
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "BSD-3-Clause": "BSD"}
    texts = {name: open(folder + f, encoding="utf-8").read() for name, f in files.items() if os.path.exists(folder + f)}
    rows = [(i, form(t)) for i, t in enumerate(texts.values()) for form in (str, str.lower, lambda t: re.sub(r"[ \t]+", " ", t))]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(*rows)).collect()}
    assert got == set(enumerate(texts))
    assert {r["license"] for r in licenses.scan(docs((1, texts["GPL-3.0"].replace("free software", "gratis software")))).collect()} == {None}


def test_licenses_in_their_usual_wrapping(docs):
    isc = ("ISC License\n\nCopyright (c) 2020, Some One\nCopyright Other Person <a@b.c>\n\n" + body("ISC")).replace("above copyright notice", "above\ncopyright notice").replace("copies. THE", "copies.\n\nTHE")
    mit = ("MIT License\n\nCopyright © 2020\n© Some One\n\n" + body("MIT")).replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS").replace("above copyright notice", "above\n * copyright notice")
    wtfpl = """            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
                    Version 2, December 2004

 Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

 Everyone is permitted to copy and distribute verbatim or modified
 copies of this license document, and changing it is allowed as long
 as the name is changed.

            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

  0. You just DO WHAT THE FUCK YOU WANT TO.
"""
    wrapped = [(name, text[:at] + "\n" + text[at + 1 :]) for name, _, text in licenses.KNOWN for at in (m.start() for m in re.finditer(" ", text))]
    texts = [("ISC", isc), ("MIT", mit), ("WTFPL", wtfpl), ("WTFPL", body("WTFPL")), *wrapped]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs(*((i, t) for i, (_, t) in enumerate(texts)))).collect()}
    assert {texts[i][0]: texts[i][1] for i in got if got[i] != texts[i][0]} == {}


def test_license_sql_finds_the_same(docs, messy):
    import duckdb

    con = duckdb.connect()
    mit = body("MIT")
    texts = [t for _, t in licenses.texts()] + ["Copyright 2020 X\ncopyright holders\n" + mit, "(c) a\n\n© b\n** Copyright: c\n" + mit, "licence licence", "copyright\nlaw of licences", "Copyright\n2020", mit + "\n(c)", "the noninfringement"]
    for df in (docs(*enumerate(texts)), messy):
        con.register("documents", df.select("doc_id", "text").toArrow())
        want = con.execute(licenses.ORACLE_SQL).fetchall()
        got = [(r["doc_id"], r["digest"], r["license"]) for r in licenses.scan(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def slow_signatures(text):
    words = [w for w in (re.sub(r"[^\w]|_", "", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)) if w]
    out, anchors = set(), set(fingerprints.ANCHORS)
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in anchors][: fingerprints.CHAIN]
        if w in anchors and len(chain) == fingerprints.CHAIN:
            out.add((w, *chain))
    if not out and text:
        out.add(("whole", *words) if words else ("text", text))
    return out


@pytest.mark.parametrize("batch", [10_000, 1, 3])
def test_fingerprints(docs, spark, batch):
    """Neighbours are found across batches as well."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        compare_fingerprints(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def compare_fingerprints(docs):
    rows = [(7 * i % 101, " ".join(f"{a} {b}" for a, b in zip(prose(i, 30 + i).split(), ("the of and river the stone is".split() * 20), strict=False))) for i in range(90)]
    rows += [(200, ""), (201, "one two"), (202, "?!"), (203, None), (204, rows[3][1])]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(*rows, parts=5)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        a, b, c = slow_signatures(text), slow_signatures(changed), slow_signatures(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
        assert len(r["fingerprint"]) == 8 * len(a) and len(r["edited_fingerprint"]) == 8 * len(b)
    assert got[204]["fingerprint"] == got[rows[3][0]]["fingerprint"] and got[200]["fingerprint"] == "" != got[202]["fingerprint"]


def test_fingerprints_of_messy_tables(messy, empty, docs):
    got = fingerprints.fingerprints(messy).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (r["doc_id"] for r in messy.collect())))
    assert fingerprints.fingerprints(empty).collect() == []
    r = fingerprints.fingerprints(docs((1, "the big red river and stone"))).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 27


def test_rows_of_one_id_are_spread_and_in_order(docs, spark):
    """A third of all rows without an id, a third with the same one: by hash of the text, over several ranges."""
    rows = [(None, f"the river {prose(i, 6)}") for i in range(60)] + [(5, f"a stone {prose(100 + i, 6)}") for i in range(60)] + [(i, f"of cloud {prose(200 + i, 6)}") for i in range(60)]
    rows += [(9, ""), (9, None), (9, "same words"), (9, "same words")]
    df = docs(*rows, parts=3)
    own = fingerprints.in_order(df).where("place = 0").groupBy(fingerprints.F.spark_partition_id()).count().collect()
    assert len(own) == 4 and max(r["count"] for r in own) < 0.4 * len(rows)
    hashes = {r["text"]: r["h"] for r in df.select("text", fingerprints.F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i is not None, i or 0), hashes[t], t or "", i) for i, t in rows)
    want = []
    for k, (_, _, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        n = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprints(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pruned_likeness():
    a, b = np.arange(10, dtype=np.uint32), np.arange(4, dtype=np.uint32)
    assert fingerprints.likeness(a, b) == 0.4 and fingerprints.likeness(a, b, 0.5) == 0.0
    assert fingerprints.likeness(a[:0], b) == 0.0 and fingerprints.likeness(a[:0], b[:0]) == 1.0


def test_near_groups(docs):
    text = "the river runs by the old stone mill and the garden of the castle is under the bridge in the morning of winter people"
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_groups(docs((1, text), (2, text + "!"), (3, text.upper()), (4, "the other text of the day is not the same in any way"))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_fingerprint_sql(docs):
    import duckdb

    rows = [(i, " ".join(f"{a} {b}" for a, b in zip(prose(i, 30 + i).split(), ("the of and river the stone is Ünder l'été für".split() * 20), strict=False))) for i in range(30)]
    rows += [(200, ""), (201, "one two"), (202, "?!"), (203, None), (204, rows[3][1]), (205, "the the the"), (None, "the a river b stone")]
    df = docs(*rows)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    got = fingerprints.fingerprints(df)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({fingerprints.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(map(repr, (tuple(r) for r in got.collect())))


def test_word_hash_is_stable():
    assert xxhash.xxh3_64_intdigest("river") == xxhash.xxh3_64_intdigest(b"river")
    s = fingerprints.signatures(pa.array(["the red river", "the red river"], pa.large_string()))
    assert s[0].tolist() == s[1].tolist() and len(s[0]) == 1
