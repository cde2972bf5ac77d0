"""Exact Jaccard join of documents on word shingles: size-banded tiles, bitmap bounds, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import GOLDEN, M1, M2, cut, drop_cut, hash_words, mix64, row_columns, split_words, text_blocks, text_rows
from lamella.llm.components import components, forest

#: Sizes of one band differ by this factor at most.
BAND_RATIO = 0.7
#: Segments on top of those that may differ, so that an empty one rarely has to stand for a match.
SPARE_SEGMENTS = 4
#: Shingles and sets of a block of a tile; a tile pairs two blocks. Smaller bands are dealt to up to
#: SPREAD blocks of PART_SETS sets as well, so that more than one task works on them.
BLOCK_SHINGLES = 6_000_000
BLOCK_SETS = 8_192
PART_SETS, SPREAD = 128, 16
#: Postings of a bucket, about (20 MB); there are as many buckets as all postings need.
BUCKET_POSTINGS = 1_000_000
#: Keys with this many postings, or 1/MOST_HOT of all, are hot: they are dealt by set instead of by key.
HOT_POSTINGS, MOST_HOT = 250_000, 50_000
#: Tasks that the buckets are dealt to at most, each bucket still a group of its own.
MOST_TASKS = 20_000
#: Sets that a task remembers in order not to post copies of them again.
SEEN = 1_000_000
#: Ids up to this number are broadcast to pick documents (16 MB at most); more are joined by shuffle.
BROADCAST_IDS = 500_000


def salt(i: int) -> np.uint64:
    return np.uint64((int(GOLDEN) * (i + 1)) % 2**64)


class Sets:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int, num: int, den: int) -> None:
        self.words, self.num, self.den = words, num, den

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        import pyarrow.compute as pc

        flat, offsets = split_words(pc.ascii_lower(texts))
        h = hash_words(flat)
        k = self.words
        rolled = mix64(h + salt(0))
        for i in range(1, k):
            rolled = rolled[:-1] * M1 + mix64(h[i:] + salt(i)) if len(rolled) > 1 else rolled[:0]
        rolled = mix64(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                s = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    s = mix64(s * M1 + h[i : i + 1])
                s = s ^ GOLDEN
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
        return out

    def band(self, n: int) -> int:
        """Band of a size: sizes from edge(band) up to below edge(band + 1)."""
        b = max(0, floor(log(n) / -log(BAND_RATIO)) - 1)
        while self.edge(b + 1) <= n:
            b += 1
        return b

    @staticmethod
    def edge(band: int) -> int:
        return ceil(BAND_RATIO ** -band)

    def least(self, n: int) -> int:
        """The smallest size that can link with a set of n."""
        return -(-n * self.num // self.den)

    def differing(self, total: int) -> int:
        """Elements that two linked sets of that many elements together may not share, at most."""
        return (self.den - self.num) * total // (self.den + self.num)

    def keys(self, s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Groups of keys of a set, and how many of a group's keys a linked set has at least.

        Any two linked sets have groups that share as many keys as both say.

        Hash space is dealt to m segments, clearly more than two linked sets with the smaller one in
        the band can differ in, so at least m - allowed segments hold the same shingles in both. A set
        gives a key for each segment with shingles, in its own band and in each lower one that a
        linked set can lie in; a linked set has all but allowed of them. A sparse set, with no more
        than allowed such segments, may share one alone with a set that isn't sparse, so it is held to
        one. Two sparse sets may agree in empty segments alone, m - allowed of them at least, so
        sparse sets give keys for those as well, which are counted apart.
        """
        n = len(s)
        out = []
        for band in range(self.band(self.least(n)), self.band(n) + 1):
            top = self.edge(band + 1) - 1
            allowed = self.differing(top + top * self.den // self.num)
            m = allowed + 1 + SPARE_SEGMENTS + allowed // 4
            segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1))
            full = segment[first]
            value = np.add.reduceat(mix64(s ^ M1), first)
            out.append((mix64(value + mix64(full * GOLDEN + salt(band))), max(1, len(full) - allowed)))
            if len(full) <= allowed:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
                out.append((mix64(mix64(empty * GOLDEN + salt(band))), m - allowed))
        return out


def identities(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set, signed; sets are told apart by both and their size. Zero for an empty set."""
    sizes = np.array([len(s) for s in found], np.int64)
    out = np.zeros((2, len(found)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(found)
        start = (np.cumsum(sizes) - sizes)[full]
        for row, mark in zip(out, (GOLDEN, M2), strict=True):
            row[full] = mix64(np.add.reduceat(mix64(flat + mark), start) + sizes[full].astype(np.uint64) * M1)
    return out[0].view(np.int64), out[1].view(np.int64)


#: Postings travel as binary columns, many in a row: keys (uint64), refs (int64), and a third column (int32).
POSTINGS = "keys binary, refs binary, more binary"
MORE_BANDS = 64


def packed(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield (b, *(c[at[b] : at[b + 1]].tobytes() for c in columns))


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("keys", np.uint64), ("refs", np.int64), ("more", np.int32)))


def sketch(docs: DataFrame, sets: Sets) -> DataFrame:
    """Per document (doc_id, n, ref, check), keys null; and the postings of each block of documents, those of equal sets once a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block in text_blocks(batches):
            found = sets.of(block.column("text"))
            refs, checks = identities(found)
            n = [len(s) for s in found]
            none = pa.nulls(len(n), pa.binary())
            yield pa.record_batch([block.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(refs), pa.array(checks), none, none, none], schema=schema)
            keys, owners, more = [], [], []
            for s, ref in zip(found, refs.tolist(), strict=True):
                if len(s) and ref not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ref)
                    for band, (key, common) in enumerate(sets.keys(s)):
                        keys.append(key)
                        owners.append(np.full(len(key), ref, np.int64))
                        more.append(np.full(len(key), common * MORE_BANDS + band, np.int32))
            if keys:
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, none, *(pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in (keys, owners, more))], schema=schema)

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "ref", "check")), *((c, pa.binary()) for c in ("keys", "refs", "more"))])
    return text_rows(docs).mapInArrow(run, "doc_id long, n long, ref long, check long, " + POSTINGS)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return start, np.diff(np.append(start, len(keys)))


def hot_keys(postings: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts), ascending: keys with very many postings, MOST_HOT at most, counted where a batch has them more than once.

    What isn't counted is a single posting of a batch, which holds some 200,000, so a key that is missed
    has no more postings than there are batches and bounds.
    """
    least = max(HOT_POSTINGS, -(-total // MOST_HOT))
    if total < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("keys"):
                keys = np.sort(np.frombuffer(blob.as_buffer(), np.uint64))
                start, length = runs(keys)
                dense = length > 1
                yield pa.record_batch([pa.array(keys[start[dense]].view(np.int64)), pa.array(length[dense].astype(np.int64))], names=["key", "n"])

    counted = postings.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    keys = np.array([r["key"] for r in counted], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in counted], np.int64)[order]


def candidates(postings: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) that tie together all refs which can be linked, as stars.

    Keys that one set alone has are dropped, the others go to their sets with their frequency. A set
    with c such keys in a band, of which a linked set has t at least, keeps its c - t + 1 rarest (none
    if c < t): two linked sets still have one in common, as both order keys alike. Only sets that
    share much keep anything, so passages that many documents share tie nothing together.

    Buckets hold about BUCKET_POSTINGS postings each. Hot keys would make one larger: they are dealt
    by set, with the frequency that was counted before, and those kept are nodes of the graph, to
    which their sets are tied one by one.
    """
    hot, hot_often = hot_keys(postings, total)
    spread = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // BUCKET_POSTINGS), min(spread, total // 50_000))
    tasks = min(buckets, MOST_TASKS)

    def is_hot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hot):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        return hot[at] == keys, at

    def home_of(values: np.ndarray) -> np.ndarray:
        return (mix64(values.view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, refs, more = unpacked({c: [batch.column(c)[i].as_py()] for c in ("keys", "refs", "more")})
                rows = list(packed(np.where(is_hot(keys)[0], home_of(refs), home_of(keys)), buckets, keys, refs, more))
                b, *columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(b, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "keys", "refs", "more"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, refs, more = unpacked(pdf)
        order = np.lexsort((refs, keys))
        keys, refs, more = keys[order], refs[order], more[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])))
        keys, refs, more = keys[new], refs[new], more[new]
        _, length = runs(keys)
        often = np.repeat(length, length)
        known, at = is_hot(keys)
        often[known] = hot_often[at[known]]
        kept = often > 1
        keys, refs, more, often = keys[kept], refs[kept], more[kept], np.minimum(often[kept], 2**31 - 1).astype(np.int32)
        both = np.stack((more, often), axis=1) if len(keys) else np.empty((0, 2), np.int32)
        rows = packed(home_of(refs), buckets, keys, refs, both)
        return pd.DataFrame([(int(b), k, r, m, int(pdf["bucket"].iloc[0])) for b, k, r, m in rows], columns=["bucket", "keys", "refs", "more", "home"])

    def rarest(pdf: pd.DataFrame) -> pd.DataFrame:
        home = np.repeat(pdf["home"].to_numpy(), pdf["refs"].str.len().to_numpy() // 8)
        keys, refs, both = unpacked(pdf)
        more, often = both.reshape(-1, 2).T
        order = np.lexsort((keys, often, more % MORE_BANDS, refs))
        keys, refs, more, home = keys[order], refs[order], more[order], home[order]
        set_of = np.concatenate(([False], (refs[1:] != refs[:-1]) | (more[1:] % MORE_BANDS != more[:-1] % MORE_BANDS))).cumsum()
        start, length = runs(set_of)
        place = np.arange(len(keys)) - np.repeat(start, length)
        kept = place <= np.repeat(length, length) - more // MORE_BANDS
        rows = packed(home[kept], buckets, keys[kept], refs[kept], more[kept])
        return pd.DataFrame(list(rows), columns=["bucket", "keys", "refs", "more"])

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, refs, _ = unpacked(pdf)
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order]
        known, _ = is_hot(keys)
        same = np.flatnonzero((keys[1:] == keys[:-1]) & (refs[1:] != refs[:-1]) & ~known[1:])
        v, m = forest(np.concatenate((refs[same + 1], refs[known])), np.concatenate((refs[same], keys[known].view(np.int64))))
        return pd.DataFrame({"a": v, "b": m})

    return (
        postings.mapInArrow(deal, "bucket int, " + POSTINGS).repartitionById(tasks, F.col("bucket"))
        .groupBy("bucket").applyInPandas(shared, f"bucket int, {POSTINGS}, home int").repartitionById(tasks, F.col("bucket"))
        .groupBy("bucket").applyInPandas(rarest, "bucket int, " + POSTINGS).repartitionById(tasks, F.col("bucket"))
        .groupBy("bucket").applyInPandas(stars, "a long, b long")
    )


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def tile_links(sets: list[np.ndarray], num: int, den: int, left: int) -> list[tuple[int, int]]:
    """Links that join the positions of each linked component among the sets.

    Breadth first: each set reached is compared with those not reached yet. Parity bitmaps bound the
    overlap from above by (n + m - differing bits) / 2; pairs whose bound suffices are intersected
    exactly. With left, the first that many sets are compared with the others only.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 64
    while bits < 4 * sizes.max():
        bits *= 2
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        maps[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    waiting = np.ones(len(sets), bool)
    found = []
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        reached = [seed]
        for i in reached:
            rest = np.flatnonzero(waiting)
            if left:
                rest = rest[(rest < left) != (i < left)]
            n, m = sizes[i], sizes[rest]
            need = -(-num * (n + m) // (num + den))
            rest, need = rest[np.minimum(n, m) >= need], need[np.minimum(n, m) >= need]
            if not len(rest):
                continue
            bound = (n + sizes[rest] - popcount(maps[rest] ^ maps[i])) // 2
            for j, least in zip(rest[bound >= need].tolist(), need[bound >= need].tolist(), strict=True):
                both = np.concatenate((sets[i], sets[j]))
                both.sort(kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= least:
                    waiting[j] = False
                    reached.append(j)
                    found.append((i, j))
    return found


def link_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document of docs.

    Words are runs of non-space characters, A-Z in lower case; a document's set is its distinct
    shingles of that many words, or its whole word sequence if it is shorter. Two documents are
    linked when den * overlap >= num * union; component_id is the smallest doc_id reachable by links,
    where rows of one doc_id are one node, whatever their texts. Shingles are told by 64 bits, equal
    sets by 128 bits and their size.

    Null and empty texts have no shingles and are linked with nothing, but for rows of the same id.
    Rows with a null doc_id get a null component and tie no others together. Repeated rows come back
    as often as they are there. An empty table gives an empty result. Other columns of docs are not read.
    """
    return link_sets(docs, Sets(words, num, den))


def link_sets(docs: DataFrame, sets: Sets) -> DataFrame:
    """link_components for the sets that `sets` makes of texts."""
    return linked(docs, sets).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.coalesce("tied", "doc_id"))).alias("component_id"))


SET = ["ref", "check", "n"]


def linked(docs: DataFrame, sets: Sets, by_id: bool = True) -> DataFrame:
    """Per row: doc_id, n, ref, check, root, first, tied.

    The nodes are distinct sets that a row with an id has, tied together by links and, with by_id, by
    ids that several of them share. root is the smallest doc_id of the set's component, and first
    tells whether this set has it (the smallest set, if several have). tied is the component of an
    id's other texts, for rows without shingles; null if there is none.
    """
    every = cut(sketch(docs, sets))
    rows = every.where("keys is null").select("doc_id", *SET)
    postings = every.where("keys is not null").select("keys", "refs", "more")
    total = (postings.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    edges = cut(candidates(postings, total))
    cluster = cut(components(edges))
    drop_cut(edges)
    members = cluster.select(F.col("node").alias("ref"), F.col("component").alias("cluster"))
    members = members.unionByName(cluster.select(F.col("component").alias("ref"), F.col("component").alias("cluster")).distinct())
    named = rows.where("n > 0 and doc_id is not null")
    first = named.groupBy(SET).agg(F.min("doc_id").alias("doc_id"))
    nodes = first.join(members, "ref").select(*SET, "doc_id", "cluster")
    ties = None
    if by_id:
        of_set = F.struct(*SET)
        several = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(of_set).alias("low"), F.max(of_set).alias("high")).where("low <> high").select("doc_id"))
        if several.limit(1).count():
            several = several.withColumn("tie", -1 - F.monotonically_increasing_id())
            tied = cut(rows.join(several, "doc_id").select("doc_id", "tie", *SET).distinct())
            others = tied.where("n > 0").select(SET).distinct().join(first, SET).join(nodes.select(SET), SET, "left_anti")
            nodes = nodes.unionByName(others.select(*SET, "doc_id", F.lit(None).cast("long").alias("cluster")))
            ties = tied
    nodes = cut(nodes).withColumn("node", F.monotonically_increasing_id())
    drop_cut(cluster)
    links = cut(verify(docs, nodes.where("cluster is not null"), sets))
    if ties is not None:
        links = links.unionByName(ties.join(nodes, SET).select(F.col("node").alias("a"), F.col("tie").alias("b")))
    label = cut(components(links))
    labelled = nodes.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    lowest = labelled.groupBy("label").agg(F.min(F.struct("doc_id", "ref", "check")).alias("low")).select(F.col("label").bitwiseXOR(F.lit(0).cast("long")).alias("label"), "low")
    is_low = (F.col("low.ref") == F.col("ref")) & (F.col("low.check") == F.col("check"))
    roots = labelled.join(lowest, "label").select(*SET, F.col("low.doc_id").alias("root"), is_low.alias("first"))
    # behind an expression, so that this side of the join has an exchange of its own and large sets can be split
    roots = first.join(roots, SET, "left").select(F.col("ref").bitwiseXOR(F.lit(0).cast("long")).alias("ref"), "check", "n", F.coalesce("root", "doc_id").alias("root"), F.coalesce("first", F.lit(True)).alias("first"))
    found = rows.join(roots, SET, "left")
    if ties is None:
        return found.withColumn("tied", F.lit(None).cast("long"))
    of_id = ties.where("n > 0").join(roots, SET).groupBy("doc_id").agg(F.min("root").alias("tied"))
    return found.join(of_id, "doc_id", "left")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that remain if one document of each group of linked texts stays, with all their columns.

    Of a group, the row with the smallest doc_id stays; ids play no other part, so rows of one id with
    different texts are documents of their own. Rows with the same id and text, or the same id and
    set, are one document. Rows with a null doc_id and those without words stay, the latter once for
    each id and text. An empty table gives an empty result.
    """
    sets = Sets(words, num, den)
    found = cut(linked(docs, sets, by_id=False))
    ids = found.where("doc_id is not null")
    repeated = cut(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    stays = (F.col("n") == 0) | (F.col("first") & (F.col("doc_id") == F.col("root")))
    gone = ids.where(~stays).select("doc_id").distinct()
    columns = row_columns(docs)
    if not repeated.limit(1).count():
        return docs.join(gone, "doc_id", "left_anti").select(columns)
    kept = docs.join(gone.unionByName(repeated).distinct(), "doc_id", "left_anti").select(columns)

    @F.pandas_udf("n long, ref long, check long")
    def identity(texts: pd.Series) -> pd.DataFrame:
        block = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
        parts = []
        for b in text_blocks(iter([block])):
            own = sets.of(b.column("text"))
            parts.append(pd.DataFrame(dict(zip(("n", "ref", "check"), ([len(s) for s in own], *identities(own)), strict=True)), dtype=np.int64))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n": [], "ref": [], "check": []}, dtype=np.int64)

    again = text_rows(docs, "*").join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    again = again.select(F.struct(columns).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("words"), identity("text").alias("set"))
    again = again.select("row", "id", F.when(F.col("set.n") == 0, F.col("words")).alias("words"), "set.*").dropDuplicates(["id", "words", "n", "ref", "check"])
    wanted = ids.join(repeated, "doc_id", "left_semi").where(stays).select(F.col("doc_id").alias("id"), *SET).distinct()
    return kept.unionByName(again.join(wanted, ["id", *SET], "left_semi").select("row.*"))


def verify(docs: DataFrame, members: DataFrame, sets: Sets) -> DataFrame:
    """Links (a, b) of nodes that connect the linked members (ref, check, n, doc_id, cluster, node) of each cluster.

    A cluster is dealt by size band and salt to blocks, and each pair of blocks of a band, or of bands
    that linked sizes can span, is a tile.
    """
    reach = ceil(log(sets.num / sets.den) / log(BAND_RATIO))
    band = F.greatest(F.lit(0), F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(BAND_RATIO)))).cast("int")
    sized = members.withColumn("band", band)
    many = F.count(F.lit(1))
    salts = F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), many / F.lit(BLOCK_SETS), F.least(F.lit(float(SPREAD)), many / F.lit(PART_SETS)))
    bands = sized.groupBy("cluster", "band").agg(F.ceil(salts).cast("int").alias("salts"))
    near = bands
    for step in range(1, reach + 1):
        for name, by in ((f"down{step}", step), (f"up{step}", -step)):
            near = near.join(bands.select("cluster", (F.col("band") + by).alias("band"), F.col("salts").alias(name)), ["cluster", "band"], "left")
    # behind an expression, so that both sides come from exchanges and a band with very many sets can be split
    near = near.withColumn("cluster", F.col("cluster").bitwiseXOR(F.lit(0).cast("long")))
    placed = sized.join(near, ["cluster", "band"]).withColumn("salt", F.pmod(F.xxhash64("ref"), F.col("salts")).cast("int"))

    def tile(low_band: object, low_salt: object, high_band: object, high_salt: object, side: object) -> object:
        return F.struct(*[F.lit(x).cast("int").alias(k) if isinstance(x, int) else x.cast("int").alias(k) for k, x in (("b1", low_band), ("s1", low_salt), ("b2", high_band), ("s2", high_salt), ("side", side))])

    own = F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1),
        lambda t: tile(F.col("band"), F.least(F.col("salt"), t), F.col("band"), F.greatest(F.col("salt"), t), F.when(F.col("salt") < t, 1).when(F.col("salt") > t, 2).otherwise(0)),
    )
    def across(step: int) -> list:
        up = F.transform(F.sequence(F.lit(0), F.col(f"up{step}") - 1), lambda t: tile(F.col("band"), F.col("salt"), F.col("band") + step, t, 1))
        down = F.transform(F.sequence(F.lit(0), F.col(f"down{step}") - 1), lambda t: tile(F.col("band") - step, t, F.col("band"), F.col("salt"), 2))
        return [F.coalesce(x, F.array().cast(own_type)) for x in (up, down)]

    tiles = [own, *(t for step in range(1, reach + 1) for t in across(step))]
    work = placed.select("doc_id", "ref", "check", "node", "cluster", F.explode(F.concat(*tiles)).alias("tile")).select("doc_id", "ref", "check", "node", "cluster", "tile.*")
    wanted = members.select("doc_id").distinct()
    count = wanted.count()
    picked = text_rows(docs).join(F.broadcast(wanted) if count <= BROADCAST_IDS else wanted, "doc_id", "left_semi")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            found = sets.of(block.column("text"))
            refs, checks = identities(found)
            columns = [block.column("doc_id").cast(pa.int64()), pa.array(refs), pa.array(checks), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "ref", "check", "shingles"])

    held = picked.mapInArrow(arrays, "doc_id long, ref long, check long, shingles binary").dropDuplicates(["doc_id", "ref", "check"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], kind="stable", ignore_index=True)
        found = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        left = int((pdf["side"] == 1).sum())
        ids = pdf["node"].to_numpy()
        pairs = np.array(tile_links(found, sets.num, sets.den, left), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return work.join(held, ["doc_id", "ref", "check"]).drop("ref", "check", "doc_id").groupBy("cluster", "b1", "s1", "b2", "s2").applyInPandas(links, "a long, b long")


own_type = "array<struct<b1:int,s1:int,b2:int,s2:int,side:int>>"


#: Every pair of documents that share a shingle is counted, and every document reaches all others of its component, so this is for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM d),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n + b.n),
linked AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (total - c) AND a IS NOT NULL AND b IS NOT NULL),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(a, m) AS (SELECT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT edges.b, reach.m FROM reach JOIN edges ON edges.a = reach.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM s LEFT JOIN (SELECT a, min(m) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
