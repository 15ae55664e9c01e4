"""Byte-pair encoding by a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 machine.

A sequence of tokens is the encoding of a piece of text exactly if each two neighbouring tokens are what merging their
bytes alone gives. So an automaton over bytes can follow, at once, every way to end the text so far: a way is a node of
the trie of the vocabulary that the bytes since the last token boundary lead to, and the tokens before. Each boundary has
just one encoding before it. The set of all ways is a state. States near the beginning of a piece and their transitions
are made when a text first needs them and then kept; further on, where few pieces are alike, a state is followed without
being kept. Either way the tokens on which all ways agree are emitted, so output lags the input by the bytes that a longer
token may still take, never by more.

A batch of texts is encoded by its distinct pieces: each is encoded once, and the ids are put together as arrays.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: How a text falls into pieces that are encoded one by one; fixed by the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("GEOSTRATA_TOKENIZERS", "/opt/tokenizers")
#: The same for texts of ASCII alone, which is quicker.
_ASCII = r"""'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
#: Pieces, their ids, and pairs of tokens that a worker keeps before it starts anew; a longer piece is not kept.
KEPT_PIECES, KEPT_IDS, KEPT_PAIRS, LONGEST_KEPT = 300_000, 5_000_000, 400_000, 64
#: Bytes from the beginning of a piece for which states are kept, and how many of them.
DETERMINED, KEPT_STATES = 3, 60_000


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(number) for token, number in (line.split() for line in blob.splitlines() if line)}


def vocabulary(name: str, folder: str = TOKENIZERS) -> bytes:
    """The content of the vocabulary file, of fixed size, as it goes to the workers: ranks, a vocabulary in JSON, or a model of pieces."""
    for ending in ("tiktoken", "json", "model"):
        path = os.path.join(folder, f"{name}.{ending}")
        if os.path.exists(path):
            with open(path, "rb") as file:
                return ending.encode() + b":" + file.read()
    raise ValueError(f"no vocabulary {name!r} in {folder}")


class _Pieces(dict):
    """Number of each piece that has been met; a new one is learned."""

    def __init__(self, learn: Callable[[str], int]):
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        number = self.learn(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = number
        return number


class Encoder:
    """Encoder of a vocabulary of byte strings whose ids are the ranks of their merges.

    Other kinds of vocabularies have other symbols than bytes, the numbers of their tokens still in the order of the
    merges, and ids by number. A way is (tokens that are not emitted yet, node of the trie, last token before the node).
    """

    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        self.ranks = ranks
        self.symbols_of = {number: token for token, number in ranks.items()}
        self.bytes_of = self.symbols_of
        self.split = regex.compile(pieces).findall
        self.split_ascii = re.compile(_ASCII).findall if pieces == PIECES else self.split
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, number in ranks.items():
            node = 0
            for byte in token:
                to = self.children[node].get(byte)
                if to is None:
                    to = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = number
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()
        self._forget_pieces()

    def _forget(self) -> None:
        start = (((), 0, -1),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _forget_pieces(self) -> None:
        self.pieces = _Pieces(self._learn)
        self.flat, self.begins = array("i"), array("q", [0])

    def _learn(self, piece: str) -> int:
        self.flat.extend(self.ids_of(piece))
        self.begins.append(len(self.flat))
        return len(self.begins) - 2

    def ids_of(self, piece: str) -> list[int]:
        return self.encode_piece(piece.encode())

    def prepared(self, text: str) -> str:
        """The text as it falls into pieces."""
        return text

    def joint(self, left: int, right: int) -> int | None:
        """The token that two tokens are merged into."""
        return self.ranks.get(self.symbols_of[left] + self.symbols_of[right])

    def merge(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Parts of data by the definition, with merges of a rank under below: the pair of least rank is merged first. For short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, and (-1, -1) for one that no merge makes."""
        if token not in self.parts:
            data = self.symbols_of[token]
            parts = self.merge(data, token)
            self.parts[token] = None if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.parts[token]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens; without a last one, whether the token's bytes give it."""
        key = (last, token)
        known = self.fits.get(key)
        if known is None:
            known = self.halves(token) != (-1, -1) and (last < 0 or self._stay_apart(last, token))
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Both tokens are taken apart again, the later merge first. What lies on the two sides of the boundary at a time must not be a pair that is merged before one of them is merged with its other neighbour."""
        left_ends = right_ends = 1 << 60
        while True:
            joint = self.joint(left, right)
            # of two merges of one rank the one further left comes first
            if joint is not None and joint < left_ends and joint <= right_ends:
                return False
            left_parts, right_parts = self.halves(left), self.halves(right)
            if left_parts is None and right_parts is None:
                return True
            if right_parts is None or (left_parts is not None and left > right):
                left_ends, left = left, left_parts[1]
            else:
                right_ends, right = right, right_parts[0]

    def _follow(self, ways: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The ways after a byte, and the tokens on which all agree."""
        met = []
        for pending, node, last in ways:
            to = self.children[node].get(byte)
            if to is None:
                continue
            met.append((pending, to, last))
            token = self.token[to]
            if token >= 0 and self.may_follow(last, token):
                met.append(((*pending, token), 0, token))
        if not met[0][0]:
            return tuple(met), ()
        agreed, first = 0, met[0][0]
        shortest = min(len(way[0]) for way in met)
        while agreed < shortest and all(way[0][agreed] == first[agreed] for way in met):
            agreed += 1
        return (tuple((p[agreed:], n, t) for p, n, t in met), first[:agreed]) if agreed else (tuple(met), ())

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        ways, emitted = self._follow(self.states[state], byte)
        number = self.number.get(ways)
        if number is None:
            number = self.number[ways] = len(self.states)
            self.states.append(ways)
            self.step.append({})
        self.step[state][byte] = (number, emitted)
        return number, emitted

    def encode_piece(self, data: bytes) -> list[int]:
        out: list[int] = []
        if len(self.states) > KEPT_STATES:
            self._forget()
        state, step = 0, self.step
        for byte in data[:DETERMINED]:
            moved = step[state].get(byte)
            if moved is None:
                moved = self._make(state, byte)
            state, emitted = moved
            out += emitted
        ways = self.states[state]
        for byte in data[DETERMINED:]:
            ways, emitted = self._follow(ways, byte)
            out += emitted
        for pending, node, _ in ways:
            if node == 0:  # the way that has a boundary just here
                out += pending
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty text or a null."""
        return self.encode_batch([text])[1].tolist()

    def encode_batch(self, texts: Sequence[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the texts' ids, with a 0 before them, and the ids; none of them with counts_only."""
        if len(self.begins) > KEPT_PIECES or len(self.flat) > KEPT_IDS:
            self._forget_pieces()
        look = self.pieces.__getitem__
        prepared = [self.prepared(text) if text else "" for text in texts]
        numbers = [list(map(look, (self.split_ascii if text.isascii() else self.split)(text))) for text in prepared]
        of_text = np.cumsum([0, *map(len, numbers)])
        piece = np.fromiter(chain.from_iterable(numbers), np.int64, int(of_text[-1]))
        begins = np.frombuffer(self.begins, np.int64)
        sizes = (begins[1:] - begins[:-1])[piece]
        ends = np.r_[0, np.cumsum(sizes)]
        if counts_only:
            return ends[of_text], np.zeros(0, np.int32)
        at = np.arange(ends[-1]) + np.repeat(begins[piece] - ends[:-1], sizes)
        return ends[of_text], np.frombuffer(self.flat, np.int32)[at] if len(at) else np.zeros(0, np.int32)


class WordEncoder(Encoder):
    """Encoder of a vocabulary of words: text is composed and in lower case, white space is dropped, and the last byte of a word is a symbol of its own. Tokens are merged by listed pairs."""

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, blob: bytes):
        model = json.loads(blob)["model"]
        letters, end = _byte_letters(), model["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            held = [letters[c] for c in token.removesuffix(end)]
            return (*held[:-1], held[-1] + 256) if token.endswith(end) and held else tuple(held)

        vocabulary_ = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # numbers: single symbols first, then the tokens in the order of their merges
        made = dict.fromkeys(a + b for a, b in merges)
        order = [t for t in vocabulary_ if t not in made and len(t.removesuffix(end)) == 1] + list(made)
        number = {t: i for i, t in enumerate(order)}
        self.pairs = {}
        for a, b in merges:
            self.pairs.setdefault((number[a], number[b]), number[a + b])
        super().__init__({symbols(t): i for t, i in number.items()}, self.WORDS)
        self.out = [vocabulary_[t] for t in order]
        space = lambda t: bytes(x & 255 for x in t) + (b" " if t[-1] > 255 else b"")
        self.bytes_of = {self.out[i]: space(t) for i, t in self.symbols_of.items()}

    def joint(self, left: int, right: int) -> int | None:
        return self.pairs.get((left, right))

    def merge(self, data: tuple[int, ...], below: int = 1 << 60) -> list[tuple[int, ...]]:
        parts = [self.ranks[(x,)] for x in data]
        while len(parts) > 1:
            rank, at = min((self.pairs.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [rank]
        return [self.symbols_of[p] for p in parts]

    def prepared(self, text: str) -> str:
        composed = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in composed) if "\u03a3" in composed else composed.lower()  # the letter at a word's end is lowered like any other

    def ids_of(self, piece: str) -> list[int]:
        data = piece.encode()
        return [self.out[t] for t in self.encode_piece((*data[:-1], data[-1] + 256))]


class PieceEncoder(Encoder):
    """Encoder of a model of pieces: the symbols are characters, a mark stands for a space, the piece of the best score is merged first, and a character without a piece gives the ids of its bytes."""

    MARK = "\u2581"

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.out = sorted(plain, key=lambda i: (-self.model.get_score(i), i))
        pieces = [self.model.id_to_piece(i) for i in self.out]
        self.whole = any(re.search(f"[^{self.MARK}]{self.MARK}", p) for p in pieces)
        self.byte_ids = {int(self.model.id_to_piece(i)[3:5], 16): i for i in ids if self.model.is_byte(i)}
        # without a piece that goes on over a space a text falls apart before each run of spaces
        super().__init__({p: k for k, p in enumerate(pieces)}, "(?s).+" if self.whole else f"{self.MARK}*[^{self.MARK}]+|{self.MARK}+")
        self.bytes_of = {self.out[k]: p.replace(self.MARK, " ").encode() for k, p in self.symbols_of.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}

    def prepared(self, text: str) -> str:
        return self.model.normalize(text)

    def ids_of(self, piece: str) -> list[int]:
        out: list[int] = []
        known: list[str] = []
        for c in [*piece, ""]:
            if c in self.ranks:
                known.append(c)
                continue
            if known:
                out += [self.out[t] for t in self.encode_piece("".join(known))]
                known.clear()
            out += [self.byte_ids.get(b, self.model.unk_id()) for b in c.encode()]
        return out


class Utf8Machine:
    """Code points out of bytes that come in any portions. Bytes that are no UTF-8 give U+FFFD once for each ill-formed part."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.code = self.code << 6 | byte & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.need, self.code = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.need, self.code = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.need, self.code = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.need else ""
        self.need, self.low, self.high = 0, 0x80, 0xBF
        return left


_encoders: dict[int, Encoder] = {}


def encoder_of(blob: bytes) -> Encoder:
    """One encoder for each vocabulary in a worker, for all its tasks."""
    key = hash(blob)
    if key not in _encoders:
        _encoders.clear()
        kind, _, content = blob.partition(b":")
        _encoders[key] = {b"tiktoken": lambda: Encoder(read_ranks(content)), b"json": lambda: WordEncoder(content), b"model": lambda: PieceEncoder(content)}[kind]()
    return _encoders[key]


def encode(documents: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): each row's text as token ids without special tokens; an empty list for an empty or a null text.

    Every row gives a row, whatever its key. No row is compared with another, so nothing moves but an input of few files. Other columns take no part.
    """
    blob = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(blob.value)
        for batch in batches:
            texts = batch.column(1)
            for begin in range(0, batch.num_rows, 1000):
                ends, flat = encoder.encode_batch(texts.slice(begin, 1000).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 1000), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[key, "ids"])

    return spread(documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"{key} long, ids array<int>")


def count_tokens(documents: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens): the number of ids that encode gives."""
    blob = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(blob.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                ends, _ = encoder.encode_batch(batch.column(1).slice(begin, 1000).to_pylist(), counts_only=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 1000), pa.array(np.diff(ends), pa.int64())], names=[key, "tokens"])

    return spread(documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"{key} long, tokens long")


def decode(encoded: DataFrame, key: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the text of each list of ids; an empty text for an empty or a null list. An id that the vocabulary lacks, or a null in the list, gives U+FFFD. A vocabulary of words gives a space after each word, a model of pieces the space before the text that it begins with."""
    blob = encoded.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder_of(blob.value).bytes_of
        for batch in batches:
            texts = []
            for one in batch.column(1).to_pylist():
                machine = Utf8Machine()
                texts.append("".join(machine.feed(bytes_of.get(i, b"\xef\xbf\xbd")) for i in one or ()) + machine.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("long").alias(key), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, f"{key} long, text string")
