"""Exact token ids at corpus speed: the tokenizers library encodes each distinct chunk once per Python worker.

The word tokenizer's normaliser and pre-tokenizer never look across ASCII white space, so a text's ids are the
concatenation of the ids of its white-space separated chunks. A worker keeps the ids of chunks it has met in a table of
bounded size that outlives a task; what it forgets is encoded again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np

from .scratch import give_back

#: What a worker remembers: so many chunks, and so many bytes of them. Beyond either, those met first stay, up to half
#: of each, the commoner chunks mostly. One batch of texts more may be held in between.
CACHE_CHUNKS = 600_000
CACHE_BYTES = 64_000_000
_ENCODE_AT_ONCE = 20_000
_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


_LATIN = re.compile("[!-~\u00a1-\u024f]+")
_RUNS = re.compile("[a-z]+|[^a-z]+")


def plain_runs(chunk: str) -> int:
    """How many pre-tokens a chunk has, if its characters tell; 0 if they do not; -1 if it is not in normal form.

    Latin letters in lower case without marks of their own are in normal form already. A run of letters is a pre-token,
    and so is a run of other characters but digits and apostrophes.
    """
    if chunk != chunk.lower() or not (chunk.isascii() or _LATIN.fullmatch(chunk)):
        return -1
    if chunk.isalpha():
        return 1
    return 0 if not chunk.isascii() or "'" in chunk or "<|" in chunk or any(map(str.isdigit, chunk)) else len(_RUNS.findall(chunk))


class _Numbers(dict):
    """Numbers of chunks in the order they are first asked for; ``new`` lists those not encoded yet."""

    def __init__(self, *args):
        super().__init__(*args)
        self.new: list[bytes] = []
        self.bytes = sum(map(len, self))

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        self.bytes += len(chunk)
        return number


class ChunkEncoder:
    """Ids of whole texts from the ids of their chunks."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole, self._plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._plain.normalizer = None  # for chunks in normal form
        self.vocab_size = self._whole.get_vocab_size()
        suffix = getattr(self._whole.model, "end_of_word_suffix", None)
        self._closes = np.zeros(self.vocab_size, bool) if suffix else None  # tokens that end a pre-token
        for token, number in self._whole.get_vocab().items() if suffix else ():
            self._closes[number] = token.endswith(suffix)
        self._limit, self._limit_bytes = cache_chunks, cache_bytes
        self._batches = 0
        self._number = _Numbers()
        self._start, self._length, self._ids = array("q"), array("i"), array("I")

    def _shrink(self) -> None:
        sizes = np.fromiter(map(len, self._number), np.int64, len(self._number))
        keep = min(self._limit // 2, int(np.searchsorted(np.cumsum(sizes), self._limit_bytes // 2, side="right")))
        self._number = _Numbers(islice(self._number.items(), keep))
        del self._start[keep:], self._length[keep:]
        end = int((np.frombuffer(self._start, np.int64) + np.frombuffer(self._length, np.int32)).max(initial=0))
        del self._ids[end:]

    def _learn(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), _ENCODE_AT_ONCE):
            texts = [c.decode() for c in chunks[at : at + _ENCODE_AT_ONCE]]
            runs_of = np.fromiter(map(plain_runs, texts), np.int64, len(texts))
            if self._closes is None:
                runs_of = np.minimum(runs_of, 0)
            lengths, ids, held = np.zeros(len(texts), np.int64), [], 0
            starts = np.empty(len(texts), np.int64)
            for own in (np.flatnonzero(runs_of > 0), np.flatnonzero(runs_of == 0), np.flatnonzero(runs_of < 0)):
                if not len(own):
                    continue
                part = [texts[i] for i in own]
                joined = runs_of[own[0]] > 0
                ends = np.arange(1, len(own) + 1)
                if joined:  # one text, whose pre-tokens are the chunks' runs in turn; their last tokens are known by a suffix
                    found = self._plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
                    last = self._closes[np.array(found.ids, np.int64)]
                    words, ends = np.cumsum(last) - last, np.cumsum(runs_of[own])
                    if int(last.sum()) != ends[-1]:
                        raise ValueError("the tokenizer splits plain chunks otherwise than expected")
                else:
                    found = (self._plain if runs_of[own[0]] == 0 else self._whole).encode(part, is_pretokenized=True, add_special_tokens=False)
                    words = np.array(found.word_ids, np.int64)
                sizes = np.bincount(words, minlength=ends[-1]) if len(words) else np.zeros(ends[-1], np.int64)
                lengths[own] = np.diff(np.cumsum(sizes)[ends - 1], prepend=0)
                ids.append(np.array(found.ids, np.uint32))
                starts[own] = held + np.cumsum(lengths[own]) - lengths[own]
                held += len(ids[-1])
            starts += len(self._ids)
            for kept, values, kind in ((self._ids, np.concatenate(ids), np.uint32), (self._start, starts, np.int64), (self._length, lengths, np.int32)):
                kept.frombytes(values.astype(kind).tobytes())

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """Chunks of a text. ASCII case is folded where that cannot change what the library does: not beside the
        special tokens, which are matched before folding, and not near combining marks, which compose before it."""
        return text.split() if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower().split()

    def encode_batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text, in order."""
        if len(self._number) > self._limit or self._number.bytes > self._limit_bytes:
            self._shrink()
        get = self._number.__getitem__
        numbers = []
        for text in texts:
            chunks = self.chunks(text)
            numbers.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
        new, self._number.new = self._number.new, []
        self._learn(new)
        self._batches += 1
        if self._batches % 4 == 0:
            give_back()
        start, length, ids = (np.frombuffer(a, t) if a else np.zeros(0, t) for a, t in ((self._start, np.int64), (self._length, np.int32), (self._ids, np.uint32)))
        for which in numbers:
            sizes = length[which].astype(np.int64)
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            yield ids[np.repeat(start[which] - (ends - sizes), sizes) + np.arange(total)]


def encoder(path: str, cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; it stays between tasks."""
    if (path, cache_chunks) not in _ENCODERS:
        _ENCODERS.clear()  # one is held at a time
        _ENCODERS[path, cache_chunks] = ChunkEncoder(path, cache_chunks)
    return _ENCODERS[path, cache_chunks]


def forget() -> None:
    """Drop what the worker's encoders remember."""
    _ENCODERS.clear()


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items of about so much size together (one larger item is a run of its own)."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(texts: list[bytes], most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes (one longer text is a run of its own)."""
    return runs([len(t) for t in texts], most_bytes)


def arrow_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty. Spark bounds the bytes of a batch, so long texts are few."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]
