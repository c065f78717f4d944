"""Token counts by overlap resynchronisation.

A document longer than one chunk is encoded as overlapping chunks. Two neighbouring encodings are spliced at a
boundary that both have and that is proven stable: the two tokens that meet there stay two tokens when their
characters are merged anew. A merge encoding is the only sequence whose adjacent tokens all pass that test, so the
spliced sequence is the encoding of the whole text. Where the overlap holds no such boundary, it is widened, in the
end to the whole rest of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
SPACE = "▁"


class Resync:
    """Encode texts of any length with a sentencepiece model, chunk by chunk."""

    def __init__(self, model: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(len(self.pieces))])
        self.lengths = np.array([1 if b else len(p.replace(SPACE, " ").encode()) for p, b in zip(self.pieces, self.is_byte, strict=True)], np.int64)
        # A character that no piece holds cannot merge with anything: it shields a chunk from the prefix the library adds.
        held = set("".join(p for p, b in zip(self.pieces, self.is_byte, strict=True) if not b))
        self.guard = next((c for c in "\n\x01\x02\x03" if c not in held), None)
        self.skip = len(self.sp.encode(self.guard)) if self.guard else 0
        self.plain = self._keeps_text()
        self.known: dict[tuple[int, int], bool] = {}
        self.widened = 0

    def _keeps_text(self) -> bool:
        """Whether the model's normaliser keeps every character, so that offsets follow from the pieces."""
        probe = "  Aéﬁ①  x\t　y "
        return bool(self.guard) and self.sp.decode(self.sp.encode(probe)) == probe

    def inner(self, text: str) -> np.ndarray:
        """Ids of a text that stands inside another: no prefix."""
        return np.array(self.sp.encode(self.guard + text)[self.skip :], np.int64)

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay these two tokens when merged anew."""
        got = self.known.get((left, right))
        if got is None:
            if self.is_byte[left] or self.is_byte[right]:
                got = True  # bytes of a character outside the vocabulary never merge
            else:
                joined = (self.pieces[left] + self.pieces[right]).replace(SPACE, " ")
                got = self.inner(joined).tolist() == [left, right]
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[left, right] = got
        return got

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, chunks) of each text."""
        short = [t for t in texts if len(t) <= self.chunk]
        counts = iter([len(x) for x in self.sp.encode(short, num_threads=1)] if short else [])
        return [(next(counts), 1) if len(t) <= self.chunk else (lambda e: (len(e[0]), e[1]))(self.encode(t)) for t in texts]

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """(ids, chunks) of one text."""
        if len(text) <= self.chunk or not self.plain:
            return np.array(self.sp.encode(text), np.int64), 1
        text = text.replace(SPACE, " ")  # the model writes a space as this sign, so both encode alike
        ids = np.array(self.sp.encode(text[: self.chunk]), np.int64)
        done: list[np.ndarray] = []
        # Byte offsets of token ends; the prefix that the library adds stands at -1.
        ends, stop, chunks = np.cumsum(self.lengths[ids]) - 1, self.chunk, 1
        size = len(text[: self.chunk].encode())
        while stop < len(text):
            wide = self.overlap
            while True:
                wide = min(wide, stop)
                begin = stop - wide
                if wide >= stop or wide > 8 * self.chunk:  # no boundary anywhere: the rest of the text at once
                    return np.array(self.sp.encode(text), np.int64), chunks
                until = min(len(text), begin + max(self.chunk, 2 * wide))
                after = self.inner(text[begin:until])
                at = size - len(text[begin:stop].encode())
                after_ends = at + np.cumsum(self.lengths[after])
                both, i, j = np.intersect1d(ends, after_ends, return_indices=True)
                found = None
                order = np.argsort(np.abs(both - (at + size) // 2), kind="stable")
                for k in order:
                    if at < both[k] < size and j[k] + 1 < len(after) and self.stable(int(ids[i[k]]), int(after[j[k] + 1])) and self._whole(ids, i[k]) and self._whole(after, j[k]):
                        found = int(i[k]), int(j[k])
                        break
                if found:
                    break
                self.widened += 1
                wide *= 4
                # The left side must reach as far back as the overlap does.
                if at < (int(ends[0]) if len(ends) else 0) and done:
                    back = done.pop()
                    ids = np.concatenate([back, ids])
                    ends = np.concatenate([ends[0] - self.lengths[ids[len(back)]] - np.cumsum(self.lengths[back][::-1])[::-1] + self.lengths[back], ends])
            done.append(ids[: found[0] + 1])
            ids, ends = after[found[1] + 1 :], after_ends[found[1] + 1 :]
            size += len(text[stop:until].encode())
            stop, chunks = until, chunks + 1
        return np.concatenate([*done, ids]), chunks

    def _whole(self, ids: np.ndarray, i: int) -> bool:
        """Whether no character is cut after token i: bytes of one character stay together."""
        if not self.is_byte[ids[i]] or i + 1 >= len(ids) or not self.is_byte[ids[i + 1]]:
            return True
        value = int(self.pieces[ids[i + 1]][3:5], 16)
        return value & 0xC0 != 0x80


_CODERS: dict[tuple, Resync] = {}


def coder_of(model: str, chunk: int, overlap: int) -> Resync:
    """One coder for each worker process."""
    key = (model, chunk, overlap)
    if key not in _CODERS:
        _CODERS[key] = Resync(model, chunk, overlap)
    return _CODERS[key]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Count the tokens of each row's ``text``.

    Adds n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks. A null or empty text has 0 bytes and tokens;
    repeated rows are counted row by row; an empty table gives an empty result; other columns than ``keep`` are ignored.
    A row is worked on alone, so there is no shuffle, and a worker holds about one megabyte of texts at a time.
    """

    def make():
        coder = coder_of(model, chunk, overlap)

        def work(texts: list[bytes]) -> dict[str, list]:
            got = coder.count([t.decode() for t in texts])
            n = [x[0] for x in got]
            return {"n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n], "n_chunks": [x[1] for x in got]}

        return work

    return per_text(
        docs, list(keep), make, [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())], "n_bytes long, n_tokens long, over_limit boolean, n_chunks int"
    ).select(*keep, F.col("n_bytes"), F.col("n_tokens"), F.col("over_limit"), F.col("n_chunks"))
