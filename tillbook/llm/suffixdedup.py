"""Byte-wise removal of long repeated strings, by a difference-cover sample and bucketed suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillbook.llm.repeats import Block, Scheme, block_rows, pack, runs, search
from tillbook.llm.words import byte_numbers

LENGTH = 100
# The differences of these numbers are all residues modulo 73.
PERIOD = 73
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)


def _numbers(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return byte_numbers()[block.raw], block.offsets


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, spans, kept for every row of ``docs``.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a row
    of a smaller id, or before in the same text. Null ids come last; rows of the
    same id follow one another in a fixed but arbitrary order. spans are the
    maximal runs removed, as (start, end) in bytes; kept are the remaining bytes.
    Null texts are empty; texts shorter than LENGTH lose nothing. Other columns
    are ignored; an empty table gives no rows. Memory of a task: one bucket of
    keys, or one block of about a megabyte, or a longer text if there is one.
    """
    answered, reader, _ = search(pack(docs, id=id, text=text), Scheme(LENGTH, PERIOD, COVER, 1.0), _numbers, merge=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            block, own, later, _, _ = reader.suffixes(row)
            gone = own.cover(np.concatenate([own.settled, own.start[later]]))
            start, end = runs(gone, own.text)
            base = block.offsets[:-1]
            pairs = pa.StructArray.from_arrays(
                [pa.array((x - base[own.text[start]]).astype(np.int32)) for x in (start, end)], ["start", "end"])
            at = np.searchsorted(own.text[start], np.arange(len(base) + 1)) if len(start) else np.zeros(len(base) + 1, int)
            left = np.add.reduceat(np.append(~gone, False), base) * (np.diff(block.offsets) > 0) if len(base) else base
            edges = np.concatenate([[0], np.cumsum(left)])
            kept = block.raw[~gone]
            yield pa.RecordBatch.from_arrays([
                block.id_column(),
                pa.array(np.diff(block.offsets)),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs),
                pa.array([kept[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            ], [id, "n_bytes", "spans", "kept"])

    return answered.mapInArrow(run, f"`{id}` long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
