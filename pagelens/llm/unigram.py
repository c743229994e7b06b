"""Token counts by trie-shared dynamic programming over a unigram piece table.

A text's pre-tokens are its runs of bytes other than space and the control characters 9 to 13, each with a word-start
mark before it. The distinct pre-tokens of a batch are walked in sorted order, which is a depth-first walk of their
trie: the best forward score and the piece count at every depth stay on a stack, so a shared prefix is scored once,
and the count at a word's end is stored for all its occurrences.

A character that is no piece costs the least score less 10 and counts as its UTF-8 bytes (byte fallback). Of equal
scores the path whose last piece starts first wins. Defined results: null and empty texts have no tokens; a null
doc_id is kept; repeated rows are counted each; an empty table gives no rows; columns other than doc_id and text are
not read, whatever their names; a long text is a batch of its own, and a long word costs its length times the longest
piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import arrow_texts, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens whose counts a worker remembers between batches, and their bytes.
CACHE_WORDS = 600_000
CACHE_BYTES = 64_000_000
_COUNTERS: dict[str, TrieCounter] = {}


def load_pieces(model_path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece model with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class TrieCounter:
    """Piece counts of pre-tokens by forward scores on the trie's current path."""

    def __init__(self, pieces: dict[str, float], cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        self._pieces = pieces
        self._longest = max(map(len, pieces), default=1)
        self._unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self._limit, self._limit_bytes = cache_words, cache_bytes
        self._counts: dict[bytes, int] = {}
        self._bytes = 0

    def terminal_counts(self, words: list[str]) -> list[int]:
        """Pieces of each word; the words are distinct and sorted."""
        get, longest = self._pieces.get, self._longest
        best, count, before, out = [0.0], [0], "", []
        for word in words:
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, n = None, 0
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if top is None or score > top:
                            top, n = score, count[start] + 1
                if word[end - 1] not in self._pieces:
                    score = self._unknown + best[end - 1]
                    if top is None or score > top:
                        top, n = score, count[end - 1] + len(word[end - 1].encode())
                best.append(top)
                count.append(n)
            out.append(count[len(word)])
            before = word
        return out

    def count_batch(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [t.split() for t in texts]
        if len(self._counts) > self._limit or self._bytes > self._limit_bytes:
            self._counts, self._bytes = {}, 0
        new = sorted((MARK + w.decode(), w) for w in set().union(*split).difference(self._counts)) if split else []
        self._bytes += sum(len(w) for _, w in new)
        self._counts.update(zip((w for _, w in new), self.terminal_counts([t for t, _ in new]), strict=True))
        get = self._counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in split]


def counter(model_path: str) -> TrieCounter:
    """The worker's counter for a model file; it stays between tasks."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = TrieCounter(load_pieces(model_path))
    return _COUNTERS[model_path]


def forget() -> None:
    """Drop what the worker's counters remember."""
    _COUNTERS.clear()


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for a, b in slices(texts):
                got = np.array(count.count_batch(texts[a:b]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
