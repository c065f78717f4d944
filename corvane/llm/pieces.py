"""Exact merge-type encoding by backtracking, and decoding, for sentencepiece vocabularies.

The encoder walks a text with the longest pieces that an Aho-Corasick automaton finds, takes a piece only if it is
compatible with the one before (the two stay two when their characters are merged anew), steps back to the next
shorter piece where nothing fits, and keeps a bitfield of positions from which no encoding goes on. Merging is never
run over the text itself.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, per_text

SPACE = "▁"
MEMO_UNITS = 120_000
MEMO_PAIRS = 250_000


class MergeCoder:
    """Encoder and decoder of one model."""

    def __init__(self, model: str, units: int = MEMO_UNITS):
        import sentencepiece

        self.most_units, self.most_pairs = units, units * MEMO_PAIRS // MEMO_UNITS

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        self.bytes = [-1] * 256
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.is_byte[i] = i, True
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(sp.decode([i]).encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece] = i
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.table = pa.array(self.surface, pa.large_binary())
        # Where no piece can stand across a place, both sides encode on their own. Both facts are checked on the vocabulary.
        glued = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = not any("\n" in p for p in self.ids)
        inner = f"[^{SPACE}\n]" if lines else f"[^{SPACE}]"
        # Signs that no piece has right after a letter: a word ends before them.
        # A letter is what a word's pattern takes, which is more than isalpha(): superscripts and fractions too.
        letter = re.compile(r"[^\W\d_]")
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if letter.match(a)}
        signs = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and c not in after_letter))
        word = f"{SPACE}*[^\\W\\d_]+(?=[{signs}{SPACE}" + ("\n" if lines else "") + "]|$)|" if signs else ""
        self.units = re.compile(word + ("\n|" if lines else "") + f"{SPACE}*{inner}+|{SPACE}+") if not glued else re.compile("(?s).+")
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pair_memo: dict[tuple[str, str], bool] = {}
        self.self_memo: dict[str, bool] = {}
        self.shorter_memo: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost on ties."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sound(self, piece: str) -> bool:
        """Whether merging a piece's characters gives that piece."""
        got = self.self_memo.get(piece)
        if got is None:
            got = self.self_memo[piece] = len(self.merge(piece)) == 1
        return got

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay two when merged anew; a character outside the vocabulary never merges."""
        got = self.pair_memo.get((left, right))
        if got is None:
            got = left not in self.ids or right not in self.ids or self.merge(left + right) == [left, right]
            if len(self.pair_memo) >= self.most_pairs:
                self.pair_memo.clear()
            self.pair_memo[left, right] = got
        return got

    def shorter(self, piece: str) -> str:
        """The next shorter sound piece that begins a piece; '' if there is none."""
        got = self.shorter_memo.get(piece)
        if got is None:
            got = ""
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.ids and self.sound(piece[:n]):
                    got = piece[:n]
                    break
            self.shorter_memo[piece] = got
        return got

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit, by backtracking."""
        n = len(unit)
        longest = [1] * n
        for last, size in self.automaton.iter(unit):
            if size > longest[last - size + 1]:
                longest[last - size + 1] = size
        dead = bytearray((n >> 3) + 1)
        out: list[str] = []
        at = 0
        pairs = self.pair_memo
        piece = unit[: longest[0]] if n else ""
        if piece in self.ids and not self.sound(piece):
            piece = self.shorter(piece)
        while at < n:
            while piece:
                end = at + len(piece)
                if not dead[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    good = pairs.get((out[-1], piece))
                    if self.compatible(out[-1], piece) if good is None else good:
                        break
                piece = self.shorter(piece)
            if piece:
                out.append(piece)
                at += len(piece)
                if at < n:
                    piece = unit[at : at + longest[at]]
                    if len(piece) > 1 and not self.sound(piece):
                        piece = self.shorter(piece)
            else:
                dead[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self.shorter(last)
        return out

    def unit_ids(self, unit: str) -> str:
        """Decimal ids of a unit, kept for its next use in two memos of bounded size: a full one becomes the older one."""
        text = self.older.get(unit)
        if text is None:
            text = self._unit_ids(unit)
        if len(self.memo) >= self.most_units:
            self.older, self.memo = self.memo, {}
        if len(unit) <= 64:
            self.memo[unit] = text
        return text

    def _unit_ids(self, unit: str) -> str:
        out = []
        for p in self.split(unit):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes[0] >= 0:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return " ".join(map(str, out))

    def encode_text(self, text: str) -> str:
        """Ids of a text with the end id, in decimal, joined by one space."""
        if not text:
            return str(self.end)
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        get = self.memo.get
        out = list(map(get, units))
        if None in out:
            make = self.unit_ids
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self.memo.get(units[i]) or make(units[i])
        out.append(str(self.end))
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        return [int(x) for x in self.encode_text(text).split()]

    def decode_many(self, rows: list[np.ndarray]) -> list[bytes]:
        """Texts of rows of ids, as UTF-8."""
        sizes = np.cumsum([0, *(len(r) for r in rows)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        got = self.table.take(pa.array(flat))
        edges = np.frombuffer(got.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = memoryview(got.buffers()[2]) if len(flat) else memoryview(b"")
        out = []
        for k, ids in enumerate(rows):
            text = bytes(data[edges[sizes[k]] : edges[sizes[k + 1]]])
            if self.is_byte[ids].any():
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._patched(ids)
            # The prefix that encoding adds goes again: the first space of the first piece that has text.
            first = next((i for i in ids.tolist() if self.surface[i]), None)
            if first is not None and not self.is_byte[first] and self.surface[first].startswith(b" ") and first != self.unknown:
                text = text[1:]
            out.append(text)
        return out

    def _patched(self, ids: np.ndarray) -> bytes:
        """Text of ids whose bytes are not all UTF-8: each stray byte becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(run) >= n:
                        out.append(run[:n])
                        run = run[n:]
                        break
                else:
                    out.append("�".encode())
                    run = run[1:]
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids."""
        return self.decode_many([np.array(ids, np.int64)])[0].decode()


def coder_of(model: str, units: int = MEMO_UNITS) -> MergeCoder:
    """One coder for each model and worker process, with its memos, until the worker runs another operator."""
    return held(("pieces", model, units), lambda: MergeCoder(model, units))


def encode_pieces(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), texts: bool = False, decoded: bool | None = None, units: int = MEMO_UNITS) -> DataFrame:
    """Encode each row's ``text`` with an end id and decode it again.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the decoded UTF-8), and with
    ``texts`` also ids (array of int) and decoded, which ``decoded`` switches alone. A null or empty text has the end id alone and decodes to ''. Equal
    texts have equal values, repeated rows stay repeated, an empty table gives an empty result, and columns other than
    ``keep`` are ignored. No shuffle; memos are bounded (by ``units``), so memory does not grow with the data or with a long text
    beyond the text itself.
    """

    decoded = texts if decoded is None else decoded

    def make():
        coder = coder_of(model, units)

        def work(rows: list[bytes]) -> dict[str, list]:
            coded = [coder.encode_text(t.decode()) for t in rows]
            ids = [np.fromstring(c, dtype=np.int64, sep=" ") for c in coded]
            back = coder.decode_many(ids)
            out = {"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in back]}
            return out | ({"ids": ids} if texts else {}) | ({"decoded": [d.decode() for d in back]} if decoded else {})

        return work

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if texts:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if decoded:
        fields.append(("decoded", pa.string()))
        ddl += ", decoded string"
    return per_text(docs, list(keep), make, fields, ddl)
