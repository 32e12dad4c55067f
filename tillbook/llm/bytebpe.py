"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizer is put together from a rank file: byte-to-character table,
vocabulary, and as merges every pair of tokens whose join is a token, by rank.
Each match of the pattern is merged on its own; special tokens don't exist.
Decoding looks up the bytes of each id and joins them before anything is read
as UTF-8, so characters split over several tokens come back whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tillbook.llm.words import chunks

# Characters handed to the library at once; bounds a worker's memory.
CHUNK_CHARS = 400_000
# The memo of a worker is emptied beyond so many pieces; longer pieces are never kept.
MEMO_PIECES = 300_000
MEMO_CHARS = 64
# Characters whose classes all versions of Unicode in use agree on. A text with any other is split by the
# tokenizers library itself, which is slower but has the tables that the pattern's ranks go with.
SETTLED = r"\x00-\u0377\u0400-\u052F\u2000-\u2064\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"


def byte_characters() -> list[str]:
    """The usual table: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file behind the pattern, once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import regex
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    written = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (written[token[:cut]], written[token[cut:]])
        for token in sorted(ranks, key=ranks.get)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    own = Tokenizer(models.BPE({written[t]: r for t, r in ranks.items()}, merges, cache_capacity=0))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    return Pieces(own, split, regex.compile(pattern), regex.compile(f"[^{SETTLED}]"))


class Pieces:
    """Encodes texts piece by piece; short pieces seen before come from a bounded memo."""

    def __init__(self, own, split, pattern, unsettled):
        self.own, self.split, self.pattern, self.unsettled, self.memo = own, split, pattern, unsettled, {}
        # one object per id for all that the memo holds
        self.numbers = tuple(range(own.get_vocab_size()))

    def pieces(self, text: str) -> list[str]:
        if self.unsettled.search(text):
            return [piece for piece, _ in self.split.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def ids(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(text) for text in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        known = self.memo
        new = list({piece for pieces in split for piece in pieces if piece not in known})
        found = dict(zip(new, (e.ids for e in self.own.encode_batch_fast(new, add_special_tokens=False))))
        out = [list(chain.from_iterable([known[p] if p in known else found[p] for p in pieces])) for pieces in split]
        known.update((piece, tuple(self.numbers[i] for i in ids)) for piece, ids in found.items() if len(piece) <= MEMO_CHARS)
        return out


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end by id, and where each begins."""
    by_id = sorted(read_ranks(path).items(), key=lambda item: item[1])
    if [rank for _, rank in by_id] != list(range(len(by_id))):
        raise ValueError("ranks must run from 0 without gaps")
    begins = np.zeros(len(by_id) + 1, np.int64)
    np.cumsum([len(token) for token, _ in by_id], out=begins[1:])
    return np.frombuffer(b"".join(token for token, _ in by_id), np.uint8), begins


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices begins[i], begins[i] + 1, ... of every run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - lengths), lengths)


def _encoder(vocabulary: str, pattern: str):
    """Replaces the last column, a text, by its ids and the byte offset after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary, pattern)
        widths = np.diff(byte_table(vocabulary)[1])
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for part in chunks(pc.utf8_length(texts).to_pylist(), CHUNK_CHARS):
                found = own.ids(texts.slice(part.start, part.stop - part.start).to_pylist())
                counts = np.array([len(ids) for ids in found], np.int64)
                flat = np.concatenate([np.array(ids, np.int32) for ids in found]) if found else np.zeros(0, np.int32)
                offsets = np.zeros(len(found) + 1, np.int64)
                np.cumsum(counts, out=offsets[1:])
                reached = np.concatenate([[0], np.cumsum(widths[flat])])
                lists = [flat, reached[1:] - np.repeat(reached[offsets[:-1]], counts)]
                at = pa.array(offsets, pa.int32())
                columns = [c.slice(part.start, part.stop - part.start) for c in batch.columns[:-1]]
                columns += [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in lists]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids", "ends"])

    return run


def _decoder(vocabulary: str, ids: str):
    """Adds the bytes of a column of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = byte_table(vocabulary)
        widths = np.diff(begins)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids))
            out = []
            for i in range(len(lists)):
                own = lists[i].values.to_numpy(zero_copy_only=False)
                out.append(table[ragged(begins[own], widths[own])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


IDS, ENDS, DECODED = (
    StructField(name, kind) for name, kind in
    (("ids", ArrayType(IntegerType())), ("ends", ArrayType(IntegerType())), ("decoded", BinaryType()))
)


def _texts(df: DataFrame, keep: list, text: str) -> tuple[DataFrame, list[StructField]]:
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows, rows.schema.fields[:-1]


def encode(df: DataFrame, vocabulary: str, pattern: str, *, keep: list, text: str = "text") -> DataFrame:
    """Columns ``keep``, ``ids`` (array of int) and ``ends`` (byte offset after each token).

    A null or empty text has no tokens. Repeated rows stay. Columns not kept are
    left out; ``keep`` must not hold ``ids`` or ``ends``.
    """
    rows, kept = _texts(df, keep, text)
    return rows.mapInArrow(_encoder(vocabulary, pattern), StructType([*kept, IDS, ENDS]))


def decode(df: DataFrame, vocabulary: str, *, keep: list, ids: str = "ids") -> DataFrame:
    """Columns ``keep``, the ids and ``decoded`` (binary). No ids, or null, give no bytes."""
    rows = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids))
    return rows.mapInArrow(_decoder(vocabulary, ids), StructType([*rows.schema.fields, DECODED]))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, *, keep: list, text: str = "text") -> DataFrame:
    """Columns ``keep``, ``ids``, ``ends`` and ``decoded``: ``encode`` and ``decode`` in one Python worker.

    A null or empty text has no ids and decodes to no bytes. Repeated rows stay;
    ``keep`` must not hold ``ids``, ``ends`` or ``decoded``. An empty table gives no rows.
    """
    rows, kept = _texts(df, keep, text)
    encoder, decoder = _encoder(vocabulary, pattern), _decoder(vocabulary, "ids")
    return rows.mapInArrow(lambda batches: decoder(encoder(batches)), StructType([*kept, IDS, ENDS, DECODED]))
