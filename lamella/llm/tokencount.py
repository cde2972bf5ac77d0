"""Word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamella.llm.common import split_words, text_blocks, text_rows

#: Distinct words whose lengths a worker remembers.
CACHE_WORDS = 500_000
WORD_START = "▁"


class Automaton:
    """A vocabulary trie with failure links and popped-token counts.

    Where the trie can't go on from a node, its failure link leads to the node of what is left after
    taking the longest pieces off the node's string, and `popped` tells how many those are; so a word
    is read once, character by character, and no piece is ever built.
    """

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[at][c] = nxt
                    self.child.append({})
                    ends.append(False)
                at = nxt
            ends[at] = ends[at] or at > 0
        self.fail: list[int] = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.child[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][c], pops
            level = below

    def length(self, word: str) -> int:
        """Pieces of the word by repeated longest match; 1 (unknown) if that gets stuck, 0 for no characters."""
        child, fail, popped = self.child, self.fail, self.popped
        at = count = 0
        for c in word:
            nxt = child[at].get(c)
            while nxt is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = child[at].get(c)
            at = nxt
        while at > 0:
            count += popped[at]
            at = fail[at]
        return 1 if at < 0 else count


def piece_vocabulary(model: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_tokens of the whole text.

    Words are runs of characters other than ASCII space; each is read with the word-start mark before
    it. A word with no full cover by longest matches counts as one unknown token. Null and empty
    texts count 0; null ids and repeated rows are counted like any others; an empty table gives an
    empty result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(piece_vocabulary(model))
        known: dict[str, int] = {}
        for block in text_blocks(batches):
            words, offsets = split_words(block.column("text"))
            coded = words.dictionary_encode()
            lengths = np.empty(len(coded.dictionary), np.int64)
            for i, w in enumerate(coded.dictionary.to_pylist()):
                n = known.get(w)
                if n is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    n = known[w] = automaton.length(WORD_START + w)
                lengths[i] = n
            sums = np.concatenate(([0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)]))) if len(words) else np.zeros(1, np.int64)
            yield pa.record_batch(
                [block.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def oracle_sql(model: str) -> str:
    """SQL for token_counts: greedy longest matches by recursion over distinct words, with the model's pieces as literals."""
    pieces = piece_vocabulary(model)
    longest = max(map(len, pieces))
    values = ", ".join("('" + p.replace("'", "''") + "')" for p in pieces)
    return f"""
    WITH RECURSIVE v(piece) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    words AS (SELECT DISTINCT unnest(w) AS word FROM d),
    step(word, tail, n) AS (
      SELECT word, '{WORD_START}' || word, 0 FROM words
      UNION ALL
      SELECT s.word, substr(s.tail, p.size + 1), s.n + 1
      FROM (SELECT t.word, t.tail, t.n, max(t.size) AS size
            FROM (SELECT word, tail, n, unnest(range(1, least(length(tail), {longest}) + 1)) AS size FROM step WHERE tail <> '') t
            JOIN v ON v.piece = substr(t.tail, 1, t.size) GROUP BY t.word, t.tail, t.n) p
      JOIN step s ON s.word = p.word AND s.tail = p.tail),
    lengths AS (SELECT words.word, coalesce(s.n, 1) AS n FROM words LEFT JOIN step s ON s.word = words.word AND s.tail = ''),
    each AS (SELECT r, unnest(w) AS word FROM d),
    sums AS (SELECT r, sum(n)::BIGINT AS n FROM each JOIN lengths USING (word) GROUP BY r)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(sums.n, 0) AS n_tokens FROM d LEFT JOIN sums USING (r)
    """
