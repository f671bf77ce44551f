"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that one pass of an Aho-Corasick automaton over the
vocabulary finds the longest token at every place. Encoding starts from longest matches and steps back to shorter
tokens, or over the last token, wherever two neighbours could not stand side by side in the result
of the merges; that test is memoised a pair. The outcome is the exact result of the merges, in time
linear in the text. Pre-tokens are met again and again, so their ids are kept in a bounded memo.

Defined results: null text is empty; empty text has no ids and decodes to no bytes; bytes that are
no UTF-8 count as U+FFFD; ids outside the vocabulary make decoding fail; equal rows are kept; extra
columns are passed by, and one with a result's name gives way to it; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwright.llm.frames import without

#: Pre-tokens up to this many bytes are kept in the memo, so many of them at most.
MEMO_BYTES, MEMO_SIZE = 64, 400_000
PAIR_MEMO = 2_000_000


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BpeCodec:
    """Encoder and decoder of one rank file, in which a token's rank is its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}
        self.words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.words[i] = token
        self.lengths = [len(w) for w in self.words]
        self.pieces = regex.compile(pattern)
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.shorter = [self._prefix(ranks, token) for token in self.words]
        self.halves: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._find_halves(ranks)
        self.fits.clear()
        self.memo: dict[str, tuple[str, list[int]]] = {}

    @staticmethod
    def _prefix(ranks: dict[bytes, int], token: bytes) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        for n in range(len(token) - 1, 0, -1):
            if (i := ranks.get(token[:n])) is not None:
                return i
        return -1

    def _find_halves(self, ranks: dict[bytes, int]) -> None:
        """The last merge of each token, found in rank order from those before."""
        for i, token in enumerate(self.words):
            left = self.shorter[i]
            while left >= 0:
                right = ranks.get(token[self.lengths[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self.joined[left, right] = i
                    self.halves.append((left, right))
                    break
                left = self.shorter[left]
            else:
                self.halves.append((i, i))

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours.

        Undoes merges from the latest on; if the ends that meet at the seam have a merge that comes
        before the one undone last, the seam would have been merged over.
        """
        bound = 1 << 62
        while True:
            over = self.joined.get((left, right))
            if over is not None and over < bound:
                return False
            for side in (0, 1) if left > right else (1, 0):
                if side == 0:
                    inner = self.halves[left][1]
                    if inner != left:
                        left, bound = inner, left
                        break
                else:
                    inner = self.halves[right][0]
                    if inner != right:
                        right, bound = inner, right + 1
                        break
            else:
                return True

    def _neighbours(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIR_MEMO:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        lengths, end, at, ids = self.lengths, len(piece), 0, []
        longest = [-1] * end
        for last, i in self.matcher.iter(piece.decode("latin-1")):
            first = last + 1 - lengths[i]
            if longest[first] < 0 or lengths[i] > lengths[longest[first]]:
                longest[first] = i
        dead = bytearray(end + 1)
        token = longest[0] if end else -1
        fits, shorter = self.fits, self.shorter
        while token >= 0 and at < end:
            last = ids[-1] if ids else -1
            while True:
                stop = at + lengths[token]
                if not dead[stop] and (last < 0 or ((ok := fits.get((last, token))) is None and self._neighbours(last, token)) or ok):
                    ids.append(token)
                    at = stop
                    token = longest[at] if at < end else -1
                    break
                token = shorter[token]
                if token < 0:
                    dead[at] = 1
                    ids.pop()
                    at -= lengths[last]
                    # the longest tokens at that place have been tried down to this one
                    token = shorter[last]
                    while token < 0 and ids:
                        dead[at] = 1
                        last = ids.pop()
                        at -= lengths[last]
                        token = shorter[last]
                    break
        return ids

    def _known(self, piece: str) -> tuple[str, list[int]]:
        if (known := self.memo.get(piece)) is None:
            ids = self.encode_piece(piece.encode())
            known = " ".join(map(str, ids)), ids
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_SIZE:
                    self.memo.clear()
                self.memo[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern separately."""
        return [i for piece in self.pieces.findall(text) for i in self._known(piece)[1]]

    def encode_listed(self, text: str) -> tuple[str, list[int]]:
        """The ids and their decimal list with single spaces."""
        parts = [self._known(piece) for piece in self.pieces.findall(text)]
        return " ".join([p[0] for p in parts]), [i for p in parts for i in p[1]]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BpeCodec:
    """One codec a worker process."""
    return BpeCodec(path, pattern)


def as_text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _mapped(df: DataFrame, given: Column, out: str, kind: str, work: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with ``out``, which ``work`` makes from ``given``; a column of that name gives way to it."""
    kept = without(df.columns, [out])
    schema = _extended(df.select(*kept), [(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], schema.names)

    return df.select(*kept, given.alias("_given")).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``out``, the array of ids of the whole ``text``."""
    path, pattern = path or _default_path(), pattern or _default_pattern()

    def work(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.encode(as_text(t.as_py())) for t in texts], pa.list_(pa.int32()))

    return _mapped(df, F.col(text).cast("binary"), out, "array<int>", work)


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``out``, the bytes that the array ``ids`` stands for; null ids count as none."""
    path, pattern = path or _default_path(), pattern or _default_pattern()

    def work(rows: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(r.as_py() or []) for r in rows], pa.binary())

    return _mapped(df, F.col(ids), out, "binary", work)


def _extended(df: DataFrame, more: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in more)).fields])


def round_trip(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` with n_tokens, and SHA-256 of the id list and of the bytes that decoding it gives.

    Encoding and decoding run in one pass over each text, so ids never leave the task.
    """
    path, pattern = path or _default_path(), pattern or _default_pattern()
    keep = without(keep, ["n_tokens", "ids_sha256", "decoded_sha256"])
    read = docs.select(*keep, F.col(text).cast("binary").alias("_bytes"))
    schema = _extended(docs.select(*keep), [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, listed, back = [], [], []
            for t in batch.column(len(keep)):
                line, ids = own.encode_listed(as_text(t.as_py()))
                n.append(len(ids))
                listed.append(sha(line.encode()))
                back.append(sha(own.decode(ids)))
            columns = [pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return read.mapInArrow(run, schema)
