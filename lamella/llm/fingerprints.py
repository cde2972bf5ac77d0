"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import GOLDEN, mix64, split_words, text_blocks, text_rows
from lamella.llm.jaccard import Sets, link_sets

#: Anchors, fixed: very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it of on or that the they this to was were which with "
    "als am auf aus bei das dem den der des die ein eine einem einen er es für ich im ist mit nicht sich sie und von zu zum "
    "au aux avec ce dans de du elle en est et il la le les ne pas par pour que qui se son sur un une "
    "al como con del el las lo los más no para pero por su una y"
).split()
#: Content words of a signature.
CHAIN = 2


def hashed(text: str) -> int:
    """The first 32 bits of the md5 of the text."""
    return int.from_bytes(hashlib.md5(text.encode(), usedforsecurity=False).digest()[:4])


def signatures(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct signatures (uint32).

    Words are lower-cased and freed of everything but letters and digits. Each anchor gives a
    signature with the CHAIN content words that follow it, other anchors skipped: a hash of them with
    a space between. A text without a full chain has one signature of all its words, or of its
    characters if it has no word; an empty text has none.
    """
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", "").to_pylist()
    anchors = set(ANCHORS)
    kind = np.fromiter((0 if not w else 1 if w in anchors else 2 for w in bare), np.int8, len(bare))
    k = kind[which]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    content = np.flatnonzero(k == 2)
    at = np.flatnonzero(k == 1)
    nth = np.searchsorted(content, at)
    fits = nth + CHAIN <= len(content)
    at, nth = at[fits], nth[fits]
    fits = owner[content[nth + CHAIN - 1]] == owner[at] if len(at) else np.empty(0, bool)
    at, nth = at[fits], nth[fits]
    # each distinct chain of a block is hashed once
    chains = np.stack([which[at], *(which[content[nth + i]] for i in range(CHAIN))], axis=1) if len(at) else np.empty((0, CHAIN + 1), np.int64)
    number = chains[:, 0]
    for i in range(1, CHAIN + 1):
        number = np.unique(number, return_inverse=True)[1] * len(bare) + chains[:, i]
    _, first, chain_of = np.unique(number, return_index=True, return_inverse=True)
    value = np.fromiter((hashed(" ".join([bare[w] for w in row])) for row in chains[first].tolist()), np.uint64, len(first))
    key = np.unique((owner[at].astype(np.uint64) << np.uint64(32)) | value[chain_of])
    bounds = np.searchsorted(key, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    out = [key[a:b].astype(np.uint32) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for i, s in enumerate(out):
        if not len(s):
            own = [bare[w] for w in which[offsets[i] : offsets[i + 1]].tolist() if bare[w]]
            if own:
                out[i] = np.array([hashed("words " + " ".join(own))], np.uint32)
            elif text := texts[i].as_py():
                out[i] = np.array([hashed("text " + text)], np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets, 1 for two empty ones; 0 where the lengths alone rule out `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def encode(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


class SpotSets(Sets):
    """SpotSigs sets for the banded join, spread over 64 bits."""

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.sort(mix64(s.astype(np.uint64) + GOLDEN)) for s in signatures(texts)]


def near_groups(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) by exact Jaccard of SpotSigs sets, partitioned by length.

    Nulls, empty texts, repeated rows and empty tables are treated as in jaccard.link_components.
    """
    return link_sets(docs, SpotSets(1, num, den))


LEAST = -(2**63)


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text): ranges of rows in order, each with the first row of the next one last.

    The order is by doc_id, nulls first, then by a hash of the text, then by text. place is 0 for a range's own
    rows, 1 for the row that follows them. Each range is a partition. Range bounds and each range's
    first row come from the ids, and from the hashes of the few ids that fill a range alone, which are
    split by hash; the text is shuffled once. The last range is followed by the first row of all.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    text_hash = F.xxhash64("text")
    quantiles = docs.select(at.alias("at")).select(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    often = Counter(quantiles)
    large = sorted(i for i, n in often.items() if n > 1)  # fewer than there are ranges
    pairs = [(i, 2**63 - 1) for i in often]
    is_large = at.isin(large) if large else F.lit(False)
    if large:
        shares = [i / parts for i in range(1, parts)]
        found = docs.where(is_large).select(at.alias("at"), text_hash.alias("hash")).groupBy("at").agg(F.percentile_approx("hash", shares, 100 * parts).alias("q")).collect()
        pairs += [(r["at"], r["q"][round(k * len(r["q"]) / often[r["at"]]) - 1]) for r in found for k in range(1, often[r["at"]])]
    pairs = sorted(set(pairs))
    bounds, bound_hashes = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else ([], [])))

    def range_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many bounds are below each row."""
        out = np.searchsorted(bounds, ids, side="left")
        for i in large:
            own, first, last = ids == i, np.searchsorted(bounds, i, side="left"), np.searchsorted(bounds, i, side="right")
            out[own] += np.searchsorted(bound_hashes[first:last], hashes[own], side="left")
        return out.astype(np.int32)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy(), hashes.to_numpy()))

    # the first row of each range, its hash only where the id is split, and each range's number, ascending
    short = F.when(is_large, text_hash).otherwise(F.lit(LEAST)) if large else F.lit(LEAST)
    keys = docs.select(at.alias("at"), short.alias("hash"))
    firsts = sorted((r["first"]["at"], r["first"]["hash"], r["b"]) for r in keys.select(bucket("at", "hash").alias("b"), F.struct("at", "hash").alias("key")).groupBy("b").agg(F.min("key").alias("first")).collect())
    starts = {(i, h): firsts[k - 1][2] for k, (i, h, _) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The row's own range, then the one that it follows, if it is the first of its own."""
        own = range_of(ids.to_numpy(), hashes.to_numpy())
        return pd.Series([[o] if (before := starts.get(key)) is None else [o, before] for o, key in zip(own.tolist(), zip(ids.tolist(), hashes.tolist(), strict=True), strict=True)])

    rows = text_rows(docs).select("doc_id", "text", text_hash.alias("hash"), F.posexplode(ranges(at, short)).alias("place", "bucket"))
    return rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "place", "doc_id", "hash", "text").select("bucket", "place", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of following."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the sorted 32-bit signatures of the whole text, eight hex digits each, so
    likeness can be told from two fingerprints alone. near_edited compares a text with its edited
    form, near_next with the next row's text in ascending doc_id; the first row follows the last.

    Null text counts as empty; an empty text has the empty fingerprint, which equals itself alone. A
    null doc_id comes before all others; rows with the same doc_id are ordered by a hash of the text, then
    by text. A single row is its own next one. An empty table gives an empty result. Other columns of docs are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: tuple | None = None  # the last own row of a range: id, text and signatures
        bucket = None
        for block in text_blocks(batches):
            texts, ids = block.column("text").to_pylist(), block.column("doc_id").to_pylist()
            pairs: list[tuple[int, int]] = []  # a row and the one that follows it; -1 is the one that waits
            last = None if wait is None else -1
            for i, (at, place) in enumerate(zip(block.column("bucket").to_pylist(), block.column("place").to_pylist(), strict=True)):
                if at != bucket:
                    last, bucket = None, at
                if last is not None:
                    pairs.append((last, i))
                last = i if place == 0 else None
            changed = [edited(wait[1] if k < 0 else texts[k], texts[i]) for k, i in pairs]
            # in one go, as a text and its edited form share most chains
            every = signatures(pa.array(texts + changed, pa.large_string()))
            rows = [wait if k < 0 else (ids[k], texts[k], every[k]) for k, _ in pairs]
            wait = None if last is None else wait if last < 0 else (ids[last], texts[last], every[last])
            if pairs:
                own, again, after = [r[2] for r in rows], every[len(texts) :], [every[i] for _, i in pairs]
                out = {
                    "doc_id": pd.array([r[0] for r in rows], "Int64"),
                    "n_chars": [len(r[1]) for r in rows],
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                    "fingerprint": [encode(s) for s in own],
                    "edited_fingerprint": [encode(s) for s in again],
                    "near_edited": [likeness(a, b) for a, b in zip(own, again, strict=True)],
                    "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
                }
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)

    return in_order(docs).mapInArrow(run, schema)


#: Ties of doc_id, which the query orders by a hash that SQL lacks, are left to the text.
ORACLE_SQL = f"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT r, doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS following FROM o),
x AS (SELECT *, substr(text, 1, n - n // 4) || substr(following, 1, n // 4) AS edited FROM n),
forms AS (SELECT r, 0 AS f, text AS t FROM x UNION ALL SELECT r, 1, edited FROM x),
split AS (
  SELECT r, f, t, list_filter(list_transform(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: w <> '') AS w
  FROM forms),
spread AS (SELECT r, f, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
kinds AS (SELECT r, f, word, i, list_contains([{", ".join(f"'{a}'" for a in ANCHORS)}], word) AS anchor FROM spread),
counted AS (SELECT *, count(*) FILTER (WHERE NOT anchor) OVER (PARTITION BY r, f ORDER BY i) AS c FROM kinds),
content AS (SELECT r, f, c, word FROM counted WHERE NOT anchor),
chains AS (
  SELECT a.r, a.f, substr(md5(a.word || ' ' || c1.word || ' ' || c2.word), 1, 8) AS s
  FROM counted a JOIN content c1 ON c1.r = a.r AND c1.f = a.f AND c1.c = a.c + 1 JOIN content c2 ON c2.r = a.r AND c2.f = a.f AND c2.c = a.c + 2 WHERE a.anchor),
found AS (SELECT r, f, list_sort(list(DISTINCT s)) AS s FROM chains GROUP BY r, f),
sets AS (
  SELECT r, f, coalesce(found.s, CASE WHEN len(w) > 0 THEN [substr(md5('words ' || array_to_string(w, ' ')), 1, 8)] WHEN t <> '' THEN [substr(md5('text ' || t), 1, 8)] ELSE [] END) AS s
  FROM split LEFT JOIN found USING (r, f)),
three AS (
  SELECT x.*, a.s AS a, b.s AS b, c.s AS c, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac
  FROM x JOIN sets a ON a.r = x.r AND a.f = 0 JOIN sets b ON b.r = x.r AND b.f = 1 JOIN sets c ON c.f = 0 AND c.r = x.r % (SELECT count(*) FROM x) + 1)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE ab / (len(a) + len(b) - ab) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE ac / (len(a) + len(c) - ac) END AS near_next
FROM three
"""
