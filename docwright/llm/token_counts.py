"""Token counts of a ``tokenizers`` file with a byte-level pre-tokenizer.

Texts are split into pre-tokens, and documents are gathered in chunks of about ``CHUNK_BYTES``. A
chunk holds its distinct pre-tokens once, with codes, and for each document the codes and their
frequencies, packed. Equal pre-tokens of all chunks meet, sorted, and the pieces of each are counted
once; the counts are gathered by chunk, packed, and joined to the documents' frequencies, and
frequency times pieces is summed a document. Ids are never made, and the rows that move are the
distinct pre-tokens of chunks, not of documents.

Defined results: null text is empty and counts 0; special strings in a text are one token each, as
the library has it; bytes that are no UTF-8 count as U+FFFD; equal rows are kept; extra columns are
ignored, and a kept column with a result's name gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import collections
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from docwright.llm.byte_bpe import as_text
from docwright.llm.frames import without
from docwright.plans.durable import stored

LIMIT = 1024
#: Bytes of text in a chunk, and pre-tokens counted in one call of the library.
CHUNK_BYTES, CALL = 32 << 20, 4096
#: Rows of counted pre-tokens that are packed by chunk at once.
PACKED = 1 << 18


class Splitter:
    """The pre-tokens of a text, as the tokenizer file has them."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        split = held.get("pre_tokenizer") or {}
        if held.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only files with a byte-level pre-tokenizer that adds no space and splits by its pattern, and no normalizer, can be counted by pre-token")
        if any(t.get(flag) for t in held["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take spaces with them, or stand as words alone, can't be counted by pre-token")
        special = [t["content"] for t in held["added_tokens"]]
        self.pieces = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens between special strings, and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return self.pieces.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pieces.findall(part)], len(parts) - 1


@lru_cache(maxsize=4)
def splitter(path: str, pattern: str) -> Splitter:
    return Splitter(path, pattern)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer, one a worker process."""
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def packed(first: np.ndarray, second: np.ndarray) -> bytes:
    """Two lists of numbers below 2 ** 32 as compressed planes of bytes."""
    planes = np.concatenate((first, second)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(given: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(given, 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
    return both[:n], both[n:]


def chunked(docs: DataFrame, keep: list[str], text: str, path: str, pattern: str, size: int) -> DataFrame:
    """(chunk, tokens, docs, pairs): distinct pre-tokens in order of code, the documents, and their packed pairs."""
    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    doc = T.StructType([*picked.schema.fields[:-1], *T.StructType.fromDDL("n_bytes bigint, n_special bigint, n_pairs bigint").fields])
    schema = T.StructType([
        T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("docs", T.ArrayType(doc)), T.StructField("pairs", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path, pattern)
        coded: dict[str, int] = {}
        steps: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows: list[pa.StructArray] = []
        total = 0

        def whole() -> pa.RecordBatch:
            held = pa.concat_arrays(rows)
            pairs = packed(np.concatenate(steps), np.concatenate(counts))
            made = [pa.array([list(coded)], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([pairs], pa.binary())]
            for x in (coded, steps, counts, rows):
                x.clear()
            return pa.RecordBatch.from_arrays(made, schema.names)

        for batch in batches:
            column, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                first, numbers = at, []
                while at < batch.num_rows and (total < size or not numbers):
                    given = column[at].as_py()
                    pieces, special = own.split(as_text(given))
                    met = collections.Counter(pieces)
                    codes = np.fromiter((coded.setdefault(p, len(coded)) for p in met), np.int64, len(met))
                    order = np.argsort(codes)
                    steps.append(np.diff(codes[order], prepend=0))
                    counts.append(np.fromiter(met.values(), np.int64, len(met))[order])
                    numbers.append((len(given), special, len(met)))
                    total += len(given)
                    at += 1
                kept = [c.slice(first, at - first) for c in batch.columns[:-1]]
                rows.append(pa.StructArray.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]], names=doc.names))
                if total >= size:
                    yield whole()
                    total = 0
        if rows:
            yield whole()

    return stored(picked.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("chunk"), "*"))


def piece_counts(tokens: DataFrame, path: str) -> DataFrame:
    """(chunk, n, coded): packed codes and numbers of pieces, from (chunk, code, token).

    Equal pre-tokens stand side by side in one task, so each is counted once.
    """
    met = tokens.repartition("token").sortWithinPartitions("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        last, held, waiting = (None, 0), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, code, pieces = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(chunk, kind="stable")
            named, begin = np.unique(chunk[order], return_index=True)
            parts = np.split(order, begin[1:])
            made = [packed(code[p], pieces[p]) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array([len(p) for p in parts], pa.int64()), pa.array(made, pa.binary())], ["chunk", "n", "coded"])

        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            fresh = [t for t in distinct if t != last[0]]
            found = []
            for at in range(0, len(fresh), CALL):
                found += [len(e.ids) for e in own.encode_batch_fast(fresh[at : at + CALL], add_special_tokens=False)]
            known = dict(zip(fresh, found, strict=True)) | {last[0]: last[1]}
            n = np.array([known[t] for t in distinct], np.int64)
            if distinct:
                last = distinct[-1], known[distinct[-1]]
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), n[np.asarray(coded.indices)]))
            waiting += batch.num_rows
            if waiting >= PACKED:
                yield from flush()
                held, waiting = [], 0
        if held:
            yield from flush()

    return met.mapInArrow(run, "chunk long, n long, coded binary")


def count_tokens(
    docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None, limit: int = LIMIT, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit of each whole text."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pattern = pattern or public_tokenizers.PATTERN
    keep = without(keep, ["n_bytes", "n_tokens", "over_limit"])
    chunks = chunked(docs, keep, text, path, pattern, chunk)
    tokens = chunks.select("chunk", F.posexplode("tokens").alias("code", "token"))
    by_chunk = piece_counts(tokens, path).groupBy("chunk").agg(F.collect_list(F.struct("n", "coded")).alias("coded"))
    joined = chunks.select("chunk", "docs", "pairs", F.size("tokens").alias("n_tokens")).join(by_chunk, "chunk", "left").select("docs", "pairs", "coded", "n_tokens")
    more = T.StructType.fromDDL("n_bytes bigint, n_tokens bigint, over_limit boolean")
    schema = T.StructType([*docs.select(*keep).schema.fields, *more.fields])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *kept, n_bytes, n_special, n_pairs = batch.column(0)[i].values.flatten()
                pairs = np.asarray(n_pairs)
                step, frequency = unpacked(batch.column(1)[i].as_py(), int(pairs.sum()))
                run_of, begin = np.cumsum(step), np.cumsum(pairs) - pairs
                before = np.concatenate(([0], run_of))[begin]
                code = run_of - np.repeat(before, pairs)
                pieces = np.zeros(batch.column(3)[i].as_py(), np.int64)
                for part in batch.column(2)[i].as_py() or []:
                    at, n = unpacked(part["coded"], part["n"])
                    pieces[at] = n
                each = pieces[code] * frequency
                sums, ends = np.concatenate(([0], np.cumsum(each))), np.cumsum(pairs)
                n = sums[ends] - sums[ends - pairs] + np.asarray(n_special)
                yield pa.RecordBatch.from_arrays([*kept, n_bytes, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], schema.names)

    return joined.mapInArrow(total, schema)
