"""Arrow batches in pieces of bounded text, for Python steps that make much of each row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that a step works on at once. A batch of Spark has a fixed number of rows, whatever their length.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts (strings in ``column``) have at most ``most`` bytes; a longer text is a run of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        first = held = 0
        for i in range(len(texts)):
            size = texts[i].as_buffer().size if texts[i].is_valid else 0
            if i > first and held + size > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if len(texts) > first:
            yield batch.slice(first)
