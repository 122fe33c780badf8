"""Token ids by the tokenizers library, each distinct piece of a block of texts encoded once.

Both public vocabularies split a text into pieces by a pattern and merge bytes inside each piece only. For texts of plain
Latin characters the same split is made here on whole blocks of bytes, each distinct piece goes through the library's
model, and its ids are copied to where the piece occurs. Any other text, and one that may hold a special token, is
encoded whole by the library. A memo keeps pieces between blocks in two generations of ``MEMO_PIECES`` at most: when the
younger is full the older one is dropped, so pieces in use stay and a worker's memory is bounded.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrow import blocks, text_buffer

MEMO_PIECES = 400_000
BLOCK = 16 << 20
_ENCODERS: dict[tuple[str, bool, bool], "Encoder"] = {}
OTHER, LETTER, DIGIT, SPACE, BLANK = range(5)


def _kind(c: str) -> int:
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER)


# Classes of one-byte characters, and of two-byte ones by lead byte (0xC2 to 0xC5) and second byte.
_ONE = np.array([SPACE if b in (9, 10, 13) else BLANK if b == 32 else _kind(chr(b)) for b in range(128)] + [OTHER] * 128, np.uint8)
_TWO = np.array([[_kind(bytes([a, b]).decode()) for b in range(0x80, 0xC0)] for a in range(0xC2, 0xC6)], np.uint8)
# Characters that are their own normal form, whose lower case is one of them, and whose class never changed.
_PLAIN = np.array([b in (9, 10, 13) or 0x20 <= b < 0x7F or 0x80 <= b < 0xC0 or 0xC2 <= b < 0xC6 for b in range(256)])
_SUSPECT = ~_PLAIN
_SUSPECT[[0xC2, 0xC4, ord("<")]] = True
# The suffixes that the split patterns of both vocabularies take first, after an apostrophe.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _not_plain(raw: np.ndarray) -> np.ndarray:
    """Places of bytes of other than plain characters, and of openings of special tokens."""
    at = np.flatnonzero(_SUSPECT[raw])  # few: most bytes need one look
    first, second = raw[at], raw[np.minimum(at + 1, len(raw) - 1)]
    bad = ~_PLAIN[first] | (first == 0xC2) & (second < 0xA1) | (first == 0xC4) & (second == 0xB0) | (first == ord("<")) & (second == ord("|"))
    return at[bad]


def piece_starts(raw: np.ndarray, edges: np.ndarray, keeps_space: bool) -> np.ndarray:
    """Where the pieces of texts that begin at ``edges`` start; the pieces tile all bytes."""
    n = len(raw)
    kind = _ONE[raw]
    lead = np.flatnonzero(raw[:-1] >= 0xC2)
    lead = lead[(raw[lead] < 0xC6) & (raw[lead + 1] >= 0x80) & (raw[lead + 1] < 0xC0)]
    kind[lead] = kind[lead + 1] = _TWO[raw[lead] - 0xC2, raw[lead + 1] - 0x80]
    begins = np.zeros(n + 1, bool)
    begins[edges] = True
    white = kind >= SPACE
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if keeps_space:
        start[1:] &= ~(white[1:] & white[:-1]) | begins[1:n]  # a run of white space is one piece ...
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:n])  # ... but for its last character before something else
        start[last] = True
        start[last[kind[last] == BLANK] + 1] = False  # a blank belongs to what follows
    else:
        start |= kind == DIGIT
        start[lead + 1] = False
    mark = np.flatnonzero(raw == ord("'"))
    if len(mark):
        before = np.where(begins[mark], SPACE, kind[np.maximum(mark - 1, 0)])
        mark = mark[(before != OTHER) & ((before != BLANK) if keeps_space else True)]
        ends = np.append(edges[1:], n)[np.searchsorted(edges, mark, side="right") - 1]
        low = np.where((raw >= 65) & (raw <= 90) & (not keeps_space), raw + np.uint8(32), raw)
        low = np.concatenate([low, np.zeros(3, np.uint8)])
        taken = np.zeros(len(mark), bool)
        for suffix in _SUFFIXES:
            fits = ~taken & (mark + len(suffix) < ends)
            for i, c in enumerate(suffix):
                fits &= low[np.minimum(mark + 1 + i, n + 2)] == ord(c)
            start[mark[fits] + 1] = False
            if len(suffix) == 2:
                start[mark[fits] + 2] = False
            after = mark[fits] + 1 + len(suffix)
            start[after[after < n]] |= kind[after[after < n]] < SPACE
            taken |= fits
    return np.flatnonzero(start)


class _Memo(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, made by ``make`` when missing."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """``encode(column)`` gives, for each text, its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keeps_space: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_space = Tokenizer.from_file(path), keeps_space
        self.tokenizer.encode_special_tokens = plain
        letters, tokenize = dict(enumerate(byte_letters())), self.tokenizer.model.tokenize

        def make(piece: bytes) -> bytes:
            if not keeps_space:
                piece = piece.strip(b" \t\n\r").decode("utf-8", "replace").lower().encode("utf-8")
            return b"".join([t.id.to_bytes(4, "little") for t in tokenize(piece.decode("latin-1").translate(letters))]) if piece else b""

        self.memo = _Memo(make, MEMO_PIECES if keeps_space else MEMO_PIECES // 4)  # without spaces there are far fewer pieces

    def starts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return piece_starts(raw, edges, self.keeps_space)

    def not_plain(self, raw: np.ndarray) -> np.ndarray:
        return _not_plain(raw)

    def token_bytes(self) -> list[bytes]:
        """Of each id the bytes it stands for."""
        letters = {c: b for b, c in enumerate(byte_letters())}
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        return [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode("utf-8") for t in tokens]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def stream(self, column: pa.Array, block: int = BLOCK) -> Iterator[bytes]:
        """The ids of one text after the other; the ids of about ``block`` bytes of text are held at once."""
        raw, offsets = text_buffer(column)
        for a, b in blocks(offsets, block):
            yield from self._block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def encode(self, column: pa.Array) -> list[bytes]:
        return list(self.stream(column))

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(raw):
            return [b""] * (len(offsets) - 1)
        edges = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        starts = self.starts(raw, edges)
        kind = pa.binary() if len(raw) < 1 << 31 else pa.large_binary()
        bounds = np.append(starts, len(raw)).astype(np.int32 if kind == pa.binary() else np.int64)
        coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        known = list(map(self.memo.__getitem__, coded.dictionary.to_pylist()))
        code = coded.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4  # a block has far fewer than 2**31 ids
        first = (np.cumsum(size, dtype=np.int32) - size)[code]
        size = size[code]
        ends = np.cumsum(size, dtype=np.int32)
        flat = np.frombuffer(b"".join(known), "<u4")
        ids = flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        cut = np.concatenate([[0], ends]).astype(np.int64)[np.searchsorted(starts, offsets)] * 4
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for row in np.unique(np.searchsorted(offsets, self.not_plain(raw), side="right") - 1).tolist():
            out[row] = self.whole(raw[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8"))
        return out


class PieceEncoder(Encoder):
    """The same for a sentencepiece model with byte fallback that adds a space before a text; the texts given here begin
    with that space.

    Where no piece has a space behind another character, no merge crosses the start of a run of spaces, so a text's runs
    from space to space are encoded apart; else texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any("\u2581" in p.lstrip("\u2581") for p in self.pieces)
        self.memo = _Memo(lambda piece: self.whole(piece.decode("utf-8", "replace")), MEMO_PIECES // 4)

    def starts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        start = np.zeros(len(raw), bool)
        if self.apart:
            start[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        start[edges] = True
        return np.flatnonzero(start)

    def not_plain(self, raw: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.int64)

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode("utf-8") for i, p in enumerate(self.pieces)]

    def whole(self, text: str) -> bytes:
        ids = self.model.encode(text[1:], num_threads=1) if text != " " else [self.model.piece_to_id("\u2581")]  # it adds no space to nothing
        return np.array(ids, "<u4").tobytes()


def encoder(path: str, keeps_space: bool, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; ``keeps_space``: white space is part of the ids (the byte-level
    vocabulary), else texts are lower-cased and white space is dropped (the one with word ends); ``plain``: special
    tokens' strings are ordinary text."""
    if (path, keeps_space, plain) not in _ENCODERS:
        _ENCODERS[path, keeps_space, plain] = Encoder(path, keeps_space, plain)
    return _ENCODERS[path, keeps_space, plain]


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a sentencepiece model."""
    if (path, True, True) not in _ENCODERS:
        _ENCODERS[path, True, True] = PieceEncoder(path)
    return _ENCODERS[path, True, True]
