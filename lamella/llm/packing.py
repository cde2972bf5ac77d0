"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import cut, release_memory, split_words, text_blocks, text_rows

#: Pieces of at most this many tokens are dealt to windows; whole windows of long texts stay as they are.
PIECE_TOKENS = 512
#: Windows that one group of pieces fills, about.
GROUP_WINDOWS = 512
#: Distinct words whose ids a worker remembers: so many recent ones, and as many older ones. A million
#: take about 280 MB.
MEMORY_WORDS = 500_000
#: What pieces that end a run of letters, or of marks, end with in the vocabulary.
WORD_END = "</w>"
MARKS = ".,!?;:"
JOINED = 4000


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer never crosses ASCII white space.

    The file must lower-case, split runs of letters from marks, and mark the piece that ends a run,
    as word_bpe_49k.json does. Each text is split at ASCII white space, each distinct word is encoded once by
    the library, and the ids of a text are those of its words in order. Words are remembered in two
    generations: when the recent one is full it becomes the older one, and the older one goes.
    """

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory_words = memory_words
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_new(self, words: list[str]) -> None:
        """Encode words by the library and remember them.

        Words of letters alone go many to a call: each is one run of letters to the pre-tokenizer, so
        its last id, and no other, is one that ends a run. Where the number of such ids isn't that of
        the words (lower-casing can add marks), and for other words, each word is encoded by itself.
        """
        recent = self.recent
        alone = [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()] if alone else words
        for start in range(0, len(letters), JOINED):
            part = letters[start : start + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                alone += part
                continue
            flat, begin = ids.tobytes(), 0
            for w, stop in zip(part, ends.tolist(), strict=True):
                recent[w] = flat[begin:stop]
                begin = stop
        for w, coded in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            recent[w] = np.array(coded.ids, "<u4").tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        recent, older = self.recent, self.older
        missing = [w for w in words if w not in recent]
        if missing:
            if len(recent) + len(missing) > self.memory_words:
                self.older = older = recent
                self.recent = recent = {}
                missing = words
            stems: dict[str, None] = {}
            compound: list[tuple[str, str, str]] = []
            new: list[str] = []
            for w in missing:
                known = older.get(w)
                if known is not None:
                    recent[w] = known
                    continue
                if w[-1] in MARKS:
                    stem = w.rstrip(MARKS)
                    if stem.isalpha():
                        marks = w[len(stem) :]
                        compound.append((w, stem, marks))
                        for x in (stem, marks):
                            if x not in recent:
                                if x in older:
                                    recent[x] = older[x]
                                else:
                                    stems[x] = None
                        continue
                new.append(w)
            stems.update(dict.fromkeys(new))
            self.encode_new(list(stems))
            # a stem that isn't one run (lower-casing and composing can give marks) may join the marks that follow
            joining = [w for w, stem, _ in compound if np.count_nonzero(self.last[np.frombuffer(recent[stem], "<u4")]) != 1]
            for w, stem, marks in compound:
                recent[w] = recent[stem] + recent[marks]
            self.encode_new(joining)
        return [recent[w] for w in words]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, four little-endian bytes each."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before lower-casing
            texts = pc.ascii_lower(texts)
        words, offsets = split_words(texts)
        del texts
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        table = self.word_ids(coded.dictionary.to_pylist())
        del words, coded
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield b"".join(map(table.__getitem__, which[start:stop].tolist()))


@functools.lru_cache(1)
def kept_encoder(path: str, memory_words: int) -> WordEncoder:
    """The worker's encoder for the file, with what it remembers from task to task."""
    return WordEncoder(path, memory_words)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, memory_words: int, keep: bool, piece: int = PIECE_TOKENS) -> DataFrame:
    """Each document's ids, then end_id, cut into whole windows, then pieces, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = (kept_encoder if keep else WordEncoder)(tokenizer, memory_words), end_id.to_bytes(4, "little")
        schema = pa.schema([(f.name, pa.int64()) for f in PIECES])
        for block in text_blocks(batches):
            out: list[tuple] = []
            for doc_id, own in zip(block.column("doc_id").to_pylist(), encoder.encode(block.column("text")), strict=True):
                own += end
                n = len(own) // 4
                whole = n - n % window
                ends = [*range(window, whole + 1, window), *range(whole + piece, n, piece)]
                ends += [n] * (whole < n)
                start = 0
                for stop in ends:
                    out.append((doc_id, start, stop - start, zlib.crc32(own[4 * start : 4 * stop]), n))
                    start = stop
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        del encoder
        release_memory()

    return text_rows(docs).mapInArrow(run, PIECES)


def difference(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each size by the largest differencing method.

    Each size starts as a partial partition: itself in one bin, the others empty. The two partial
    partitions with the largest spread are merged, fullest bins of one with emptiest of the other,
    until one is left.
    """
    if bins == 1:
        return np.zeros(len(sizes), np.int64)
    heap: list[tuple] = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), [[i]]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, abins = heapq.heappop(heap)
        _, _, b, bbins = heapq.heappop(heap)
        # both hold their non-empty bins, fullest first; the others are empty
        n, m = len(a), len(b)
        if n + m <= bins:
            sums, members = np.concatenate((a, b)), abins + bbins
        else:
            pad = bins - n  # so many of b's bins meet an empty bin of a
            over = m - pad
            sums = np.concatenate((a, b[:pad])) if pad else a.copy()
            members = abins + bbins[:pad]
            tail = b[pad:]
            # the fullest of the rest of b meets the emptiest of a
            sums[n - over : n] = a[n - over : n] + tail[::-1] if over else a[n:]
            for j in range(over):
                at = n - 1 - j
                members[at] = members[at] + bbins[pad + j]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        members = [members[j] for j in order.tolist()]
        low = sums[-1] if len(sums) == bins else 0
        heapq.heappush(heap, (-int(sums[0] - low), serial, sums, members))
        serial += 1
    out = np.empty(len(sizes), np.int64)
    for j, inside in enumerate(heap[0][3]):
        out[inside] = j
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; one window more as long as differencing exceeds the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, count)
        if np.bincount(at, weights=sizes, minlength=count).max() <= capacity:
            return at
        count += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, memory_words: int = MEMORY_WORDS, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text of at least one window gives whole windows, each a sequence of its own. The rests of all
    texts, in pieces of at most PIECE_TOKENS ids, are dealt at random to groups that fill about
    GROUP_WINDOWS windows; each group is packed by itself, so no task sees more than a group. Workers
    remember the ids of 2 * memory_words words, with keep from task to task; less memory takes more time.

    Null or empty text is the end id alone. Repeated rows and null ids are packed like any others.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = cut(cut_pieces(docs, tokenizer, window, end_id, memory_words, keep)).withColumn("row", F.monotonically_increasing_id())
    whole = rows.where(F.col("length") == window).withColumn("sequence_id", 2 * F.col("row") + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.where(F.col("length") < window)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * GROUP_WINDOWS)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "row"], kind="stable", ignore_index=True)
        at = windows(pdf["length"].to_numpy(), window)
        pdf = pdf.iloc[np.argsort(at, kind="stable")]
        at = np.sort(at, kind="stable")
        size = pdf["length"].to_numpy()
        before = np.cumsum(size) - size
        first = np.searchsorted(at, at)
        return pdf.drop(columns=["row", "group"]).assign(sequence_id=2 * ((int(key[0]) << 20) + at), offset=before - before[first])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInPandas(fill, schema)
    return whole.drop("row").unionByName(packed)
