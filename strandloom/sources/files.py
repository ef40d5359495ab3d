"""Writing ordered lines: as one file, or as the parts of a folder."""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..plans.checks import one_of

BLOCK = 65_280


def bgzf(chunks: Iterable[bytes], level: int = 6) -> Iterable[bytes]:
    """Blocked gzip as the SAM specification has it: independent members of at most 64 KiB, then an empty one."""

    def block(data: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        head = struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        return head + body + struct.pack("<II", zlib.crc32(data), len(data))

    held = b""
    for c in chunks:
        held += c
        while len(held) >= BLOCK:
            yield block(held[:BLOCK])
            held = held[BLOCK:]
    if held:
        yield block(held)
    yield block(b"")


def write_lines(lines: DataFrame, order: list[str], path: str, compress: str | None = None, overwrite: bool = False, single_file: bool = True) -> str:
    """The value column in order, as <path>, <path>.gz, or a folder of sorted parts if not single_file.

    A single file is streamed through the driver partition by partition.
    """
    one_of("compress", compress, (None, "gzip", "bgzip"))
    path += ".gz" if compress else ""
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    if not single_file:
        ordered.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip" if compress else "none").text(path)
        return path
    path = os.path.expanduser(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(f"{path} exists")
    text = (r["value"].encode() + b"\n" for r in ordered.toLocalIterator())
    if compress == "bgzip":
        with open(path, "wb") as f:
            for b in bgzf(text):
                f.write(b)
    else:
        with gzip.open(path, "wb") if compress else open(path, "wb") as f:
            f.writelines(text)
    return path
