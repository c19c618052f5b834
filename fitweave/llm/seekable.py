"""Token files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file:

    data frames    zstandard frames with content checksums; token ids as little-endian
                   unsigned 32-bit integers; a frame holds whole documents, or a part of
                   one long document
    index          skippable frame 0x184D2A50: zstandard frame of doc ids (int64),
                   validity (uint8), ids before the document (uint64), ids (uint64)
    seek table     skippable frame 0x184D2A5E of the seekable zstandard format: for each
                   data frame its compressed and decompressed size and a checksum (low 32
                   bits of xxh64 of the decompressed bytes), then frame count, flags, magic

A reader takes the last bytes of a file, then only the frames of the documents
that it wants; a damaged frame fails on its own checksum and leaves the others readable.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs as arrow_fs

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS, LONG_FRAME_IDS = 1 << 14, 1 << 18
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
_TAIL = struct.Struct("<IBI")


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, path) of a full URI, for executors without a JVM."""
    return arrow_fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file under a name of its own, which becomes the final name on close."""

    def __init__(self, uri: str, frame_ids: int = FRAME_IDS):
        self.files, self.path = opened(uri)
        self.scratch = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.scratch, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frame_ids, self.pending, self.held = frame_ids, [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        ids = np.ascontiguousarray(ids, dtype="<u4")
        if self.held and self.held + len(ids) > LONG_FRAME_IDS:
            self._cut()
        while len(ids) > LONG_FRAME_IDS:
            self.pending, self.held, ids = [ids[:LONG_FRAME_IDS]], LONG_FRAME_IDS, ids[LONG_FRAME_IDS:]
            self._cut()
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self._cut()

    def _cut(self) -> None:
        plain = b"".join(x.tobytes() for x in self.pending)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._cut()
        sizes = np.array(self.sizes, dtype="<u8")
        valid = np.array([x is not None for x in self.ids], dtype=np.uint8)
        ids = np.array([x if x is not None else 0 for x in self.ids], dtype="<i8")
        before = (np.cumsum(sizes) - sizes).astype("<u8")
        index = self.packer.compress(ids.tobytes() + valid.tobytes() + before.tobytes() + sizes.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.entries, dtype=_ENTRY).tobytes() + _TAIL.pack(len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        self.files.move(self.scratch, self.path)


class Reader:
    """Random access to the documents of one file; holds the index and one frame."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self.file = files.open_input_file(path)
        total = self.file.size()
        n, flags, magic = _TAIL.unpack(self._at(total - _TAIL.size, _TAIL.size))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        self.frames = np.frombuffer(self._at(total - _TAIL.size - n * _ENTRY.itemsize, n * _ENTRY.itemsize), dtype=_ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self.firsts = np.concatenate([[0], np.cumsum(self.frames["plain"], dtype=np.int64)]) // 4  # ids before each frame
        magic, size = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri}: no document index")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[-1]) + 8, size))
        docs = len(index) // 25
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.valid = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
        self.before = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.sizes = np.frombuffer(index, "<u8", docs, 17 * docs).astype(np.int64)
        self.frames_read, self._held = 0, (-1, np.zeros(0, dtype="<u4"))

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place) if size else b""

    def _frame(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), int(self.frames["packed"][k])), max_output_size=int(self.frames["plain"][k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.frames["checksum"][k]):
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, np.frombuffer(plain, "<u4"))
            self.frames_read += 1
        return self._held[1]

    def parts(self, position: int) -> Iterator[np.ndarray]:
        """The ids of the document at an index position, frame by frame."""
        low, size = int(self.before[position]), int(self.sizes[position])
        k = int(np.searchsorted(self.firsts, low, side="right")) - 1
        while size:
            ids = self._frame(k)[low - int(self.firsts[k]) :][:size]
            yield ids
            low, size, k = low + len(ids), size - len(ids), k + 1

    def document(self, doc_id: int) -> np.ndarray:
        """All ids of the first document with this id."""
        found = np.flatnonzero(self.valid & (self.doc_ids == doc_id))
        if not len(found):
            raise KeyError(doc_id)
        return np.concatenate([np.zeros(0, dtype="<u4"), *self.parts(int(found[0]))])
