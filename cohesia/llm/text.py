"""Text helpers that the Python-side operators share. Everything works on whole texts in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text that are tokenised at a time.
BLOCK = 1 << 20


def byte_rows(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each row of a string column; a null row gives None."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from byte_rows(chunk)
        return
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in pc.cast(column, binary):
        yield value.as_py()


def word_blocks(data: bytes, table: bytes | None = None) -> Iterator[list[bytes]]:
    """Words of ``data`` between ASCII white space, after translating bytes by ``table``, block by block.

    A block ends at white space, so no word is cut and the list of words stays small for any length of text.
    """
    if table is not None:
        data = data.translate(table)
    start, size = 0, len(data)
    while start < size:
        end = start + BLOCK
        if end < size:
            while end < size and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield data[start:end].split()
        start = end


#: Byte translation that lower-cases A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte translation that lower-cases A-Z and turns every byte outside 0-9, a-z and UTF-8 sequences into a space.
LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
