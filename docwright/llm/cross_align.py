"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded as space + text by a byte-level BPE file (A) and as the text by a sentencepiece
model (B), which adds the space itself. B's tokens never cross from a word to the spaces after it, so
its library encodes each distinct word once and a bounded memo gives the rest. A's file is read as ranks,
whose merges run four times as fast as the file's own library, if they must give the same ids: where every token's id is the rank of its
merge and every token encodes to itself, a merge by rank alone can't differ from the listed one. Tokens have byte
ranges; a batch's tokens of all documents go through ``pandas.merge_asof``, keyed by document, once
in each direction: every token start finds the token of the other side that covers it. The union of
both directions is every pair whose ranges overlap; pairs that also end together close a group.

Corpus-wide counts of pairs that end together are kept a document, summed on Spark and met again. Of two tokens that
end together one's bytes end the other's, so a token has at most as many shorter partners as it has
bytes: distinct pairs are bounded by the bytes of the two vocabularies, some 500,000 here, whatever the corpus.
That bound is what lets their counts be broadcast.

Defined results: texts that are null or empty, or whose joined bytes of either side differ from
space + text, have no tokens; bytes that are no UTF-8 count as U+FFFD; special strings are plain text;
equal rows are kept; extra columns are passed by, and a kept column with a result's name gives way to
it; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer, models

from docwright.llm.byte_bpe import as_text
from docwright.llm.frames import without
from docwright.plans.durable import stored

#: Bytes of texts that are aligned at once, units up to this many characters are kept in the memo, so many of them at most.
BATCH_BYTES, MEMO_CHARS, MEMO_SIZE = 2 << 20, 64, 300_000
#: A run of spaces and what follows it up to the next space.
UNIT = re.compile(r" *[^ ]+| +")
SPACE = "▁"
SHIFT = 32

def byte_chars() -> dict[str, int]:
    """Byte-level BPE's printable stand-in of each byte, as character to byte: visible bytes stand for themselves, the others for 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """The bytes of each id of one tokenizer, and how ids are written."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        listed = [str(i) for i in range(len(words))]
        #: The ids as text with each of the marks that may follow: inside a group, after A's part, after B's part.
        self.listed = np.array([[i + mark for i in listed] for mark in ",|;"], object)


class ByteSide(Side):
    """A ``tokenizers`` file with byte-level BPE; special strings are plain text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        split = held.get("pre_tokenizer") or {}
        if held.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only files with a byte-level pre-tokenizer that splits by its own pattern, and no normalizer, can be aligned")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        back, vocabulary = byte_chars(), self.library.get_vocab(with_added_tokens=False)
        # added tokens may stand in the vocabulary as well; they are no result of a merge
        known = {t: i for t, i in vocabulary.items() if t not in {x["content"] for x in held["added_tokens"]}}
        words = [b""] * (max(vocabulary.values()) + 1)
        for token, i in known.items():
            words[i] = bytes(back[c] for c in token)
        super().__init__(words)
        self.ranks = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks={words[i]: i for i in known.values()}, special_tokens={}) if self._by_rank(held["model"], known) else None

    @staticmethod
    def _by_rank(model: dict, known: dict[str, int]) -> bool:
        """Whether merging by rank gives what the listed merges give."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = sorted(known.values()) == list(range(len(known))) and [known.get(x + y) for x, y in pairs] == list(range(len(known) - len(pairs), len(known)))
        alone = Tokenizer(models.BPE(vocab=model["vocab"], merges=[tuple(p) for p in pairs]))
        return in_order and [e.ids for e in alone.encode_batch(list(known), add_special_tokens=False)] == [[i] for i in known.values()]

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceSide(Side):
    """A sentencepiece model that puts a space before the text; its pieces hold spaces at their start only.

    So nothing is merged over the end of a word, and words with the spaces before them are encoded apart.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("only models whose pieces hold spaces at their start can be encoded by word")
        super().__init__([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.alone = (self.library.piece_to_id(SPACE),)
        self.memo: dict[str, tuple[int, ...]] = {}

    def _unit(self, given: str) -> tuple[int, ...]:
        """The ids of a unit, none where their bytes aren't the unit's; it begins with a space, which the model adds again unless nothing follows."""
        ids = tuple(self.library.encode(given[1:])) if len(given) > 1 else self.alone
        if b"".join([self.words[i] for i in ids]) != given.encode():
            ids = ()
        if len(given) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[given] = ids
        return ids

    def ids(self, text: str) -> np.ndarray | None:
        """The ids of a text that begins with a space; None where their bytes aren't the text's."""
        units = UNIT.findall(text)
        known = list(map(self.memo.get, units))
        if not all(known):
            known = [self._unit(u) if k is None else k for u, k in zip(units, known, strict=True)]
            if not all(known):
                return None
        return np.fromiter(itertools.chain.from_iterable(known), np.int64, sum(map(len, known)))


@dataclasses.dataclass
class Sides:
    a: ByteSide
    b: PieceSide

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of ``text`` on both sides; None where the bytes of either aren't the text's."""
        of_b = self.b.ids(text)
        if of_b is None:
            return None
        of_a = self.a.ids(text)
        return (of_a, of_b) if self.a.lengths[of_a].sum() == self.b.lengths[of_b].sum() else None


@lru_cache(maxsize=2)
def sides(json_path: str, pattern: str, model_path: str) -> Sides:
    """Both tokenizers, one pair a worker process."""
    return Sides(ByteSide(json_path, pattern), PieceSide(model_path))


def paths(json_path: str | None, pattern: str | None, model_path: str | None) -> tuple[str, str, str]:
    import public_tokenizers

    return json_path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN, model_path or public_tokenizers.path("piece_bpe_32k.model")


@dataclasses.dataclass
class Tokens:
    """Tokens of several documents in order, with byte ranges that run on from document to document.

    ``last`` marks tokens that end a group, ``group`` counts those before.
    """

    doc: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    last: np.ndarray
    group: np.ndarray

    def first(self, of: np.ndarray, n: int) -> np.ndarray:
        """The value in ``of`` of each document's first token; 0 for documents without tokens."""
        at = np.searchsorted(self.doc, np.arange(n))
        return np.append(of, 0)[at] * (np.bincount(self.doc, minlength=n) > 0)


def tokens_of(side: Side, ids: list[np.ndarray]) -> Tokens:
    counts = [len(x) for x in ids]
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    length = side.lengths[flat]
    end = np.cumsum(length)
    none = np.zeros(0, np.int64)
    return Tokens(np.repeat(np.arange(len(ids)), counts), flat, end - length, end, none, none)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens whose byte ranges overlap, every pair once, in order.

    A token that starts inside the other side's token overlaps it, and of two that overlap the later
    start lies inside the other; starts that fall together are found from A's side alone.
    """
    of_a = pd.DataFrame({"doc": a.doc, "start": a.start, "a_at": np.arange(len(a.doc)), "a_start": a.start})
    of_b = pd.DataFrame({"doc": b.doc, "start": b.start, "b_at": np.arange(len(b.doc))})
    onto_b = pd.merge_asof(of_a[["doc", "start", "a_at"]], of_b, on="start", by="doc")
    onto_a = pd.merge_asof(of_b, of_a, on="start", by="doc")
    inside = onto_a["start"].to_numpy() != onto_a["a_start"].to_numpy()
    left = np.concatenate((onto_b["a_at"].to_numpy(), onto_a["a_at"].to_numpy()[inside]))
    right = np.concatenate((onto_b["b_at"].to_numpy(), onto_a["b_at"].to_numpy()[inside]))
    order = np.argsort(left + right, kind="stable")  # from one overlap to the next at least one place goes up
    return left[order], right[order]


def aligned(texts: list[str], both: Sides) -> tuple[list[bool], Tokens, Tokens, tuple[np.ndarray, np.ndarray]]:
    """Which texts have tokens, the tokens of both sides with their groups, and the overlaps."""
    found = [both.ids(" " + text) if text else None for text in texts]
    has, none = [f is not None for f in found], np.zeros(0, np.int64)
    left, right = (tokens_of(side, [none if f is None else f[k] for f in found]) for k, side in enumerate((both.a, both.b)))
    pairs = overlaps(left, right)
    closing = left.end[pairs[0]] == right.end[pairs[1]]
    for side, at in zip((left, right), pairs, strict=True):
        side.last = np.zeros(len(side.doc), bool)
        side.last[at[closing]] = True
        side.group = np.cumsum(side.last) - side.last
    return has, left, right, pairs


def group_lists(left: Tokens, right: Tokens, both: Sides, n: int) -> list[str]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    n_groups = int(left.last.sum())
    # before a token stand its own side's earlier tokens and the other side's groups before, for B also A's part of its group
    upto_a, upto_b = (np.cumsum(np.bincount(x.group, minlength=n_groups + 1)) for x in (left, right))
    at_a = np.arange(len(left.doc)) + np.concatenate(([0], upto_b))[left.group]
    at_b = np.arange(len(right.doc)) + upto_a[right.group]
    out = np.empty(len(at_a) + len(at_b), object)
    out[at_a] = both.a.listed[left.last.astype(np.int64), left.ids]
    out[at_b] = both.b.listed[2 * right.last.astype(np.int64), right.ids]
    ends = np.cumsum(np.bincount(left.doc, minlength=n) + np.bincount(right.doc, minlength=n)).tolist()
    return ["".join(out[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]


def _batches(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` bytes, with their first row; a longer text is a run of its own."""
    first, held, total = 0, [], 0
    for at, given in enumerate(column):
        held.append(as_text(given.as_py()))
        total += len(held[-1])
        if total >= size:
            yield first, held
            first, held, total = at + 1, [], 0
    if held:
        yield first, held


def align(
    docs: DataFrame, keep: list[str], text: str = "text", json_path: str | None = None, pattern: str | None = None, model_path: str | None = None
) -> DataFrame:
    """A row for each pair of overlapping tokens: ``keep``, places and ids of both, its group, whether they end together.

    Places are within the document and groups within it too, all from 0.
    """
    given = paths(json_path, pattern, model_path)
    more = T.StructType.fromDDL("a_at int, b_at int, a_id int, b_id int, group_at int, ends_together boolean")
    keep = without(keep, more.names)
    schema = T.StructType([*docs.select(*keep).schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*given)
        for batch in batches:
            for first, texts in _batches(batch.column(len(keep)), BATCH_BYTES):
                _, left, right, (at_a, at_b) = aligned(texts, both)
                doc = left.doc[at_a]
                begin = lambda side, of: side.first(of, len(texts))[doc]
                made = [
                    at_a - begin(left, np.arange(len(left.doc))), at_b - begin(right, np.arange(len(right.doc))),
                    left.ids[at_a], right.ids[at_b], left.group[at_a] - begin(left, left.group),
                ]
                kept = [c.take(pa.array(doc + first)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(m.astype(np.int32)) for m in made], pa.array(left.end[at_a] == right.end[at_b])], schema.names)

    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes")).mapInArrow(run, schema)


def documents(
    docs: DataFrame, keep: list[str], text: str = "text", json_path: str | None = None, pattern: str | None = None, model_path: str | None = None
) -> DataFrame:
    """A row a document: ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs with frequencies.

    A link is a pair that ends together; a pair is a_id * 2 ** 32 + b_id.
    """
    given = paths(json_path, pattern, model_path)
    more = T.StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")
    keep = without(keep, more.names)
    schema = T.StructType([*docs.select(*keep).schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*given)
        for batch in batches:
            for first, texts in _batches(batch.column(len(keep)), BATCH_BYTES):
                has, left, right, (at_a, at_b) = aligned(texts, both)
                n = len(texts)
                together = left.end[at_a] == right.end[at_b]
                at_a, at_b = at_a[together], at_b[together]
                codes = (left.ids[at_a] << SHIFT) | right.ids[at_b]
                n_links = np.bincount(left.doc[at_a], minlength=n)
                ends = np.cumsum(n_links)
                found = [np.unique(codes[y - k : y], return_counts=True) for y, k in zip(ends.tolist(), n_links.tolist(), strict=True)]
                offsets = pa.array(np.cumsum([0, *[len(x) for x, _ in found]]), pa.int32())
                values = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32()), strict=True)]
                listed = group_lists(left, right, both, n)
                count = lambda doc: pa.array(np.bincount(doc, minlength=n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, n) for c in batch.columns[:-1]], count(left.doc), count(right.doc), count(left.doc[left.last]), pa.array(n_links, pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() if ok else "" for x, ok in zip(listed, has, strict=True)], pa.string()),
                        *[pa.ListArray.from_arrays(offsets, v) for v in values],
                    ],
                    schema.names,
                )

    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes")).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair corpus-wide, and whether it's the highest count of its B id."""
    each = found.select(F.inline(F.arrays_zip("pairs", "times")))
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1))  # as many pairs as the A vocabulary allows
    return counted.withColumn("best", F.col("count") == F.max("count").over(of_b))


def link_counts(
    docs: DataFrame, keep: list[str], text: str = "text", json_path: str | None = None, pattern: str | None = None, model_path: str | None = None
) -> DataFrame:
    """``keep`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    keep = without(keep, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    made = documents(docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(text).alias("text")), [f"k_{c}" for c in keep], "text", json_path, pattern, model_path)
    found = stored(made.select(F.monotonically_increasing_id().alias("row"), "*"))
    counts = F.broadcast(pair_counts(found))
    own = [c for c in found.columns if c not in ("pairs", "times")]
    each = found.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("link"))
    met = each.join(counts, F.col("link.pairs") == F.col("pair"), "left")
    summed = met.groupBy(*own).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("link.times"))), F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce(F.sum(F.col("count") * F.col("link.times")), F.lit(0)).cast("bigint").alias("count_sum"),
    )
    return summed.select(*[F.col(f"k_{c}").alias(c) for c in keep], "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
