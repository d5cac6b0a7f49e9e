"""Token shards as wavelet matrices: one compressed file per shard that can be read back whole or queried in place.

Format (little-endian): magic WMX2, u8 bits, u64 tokens, u64 documents, u32 bytes of a block, u32 size of the document table;
for each plane, high bit first, u64 zeros, u64 place of its first block, the places of all blocks and of the end relative to
that (u32), and the ones before each block (u32); the zstd-compressed document table (all ids as i64, all token counts as u32); the
zstd-compressed blocks (bit i of a plane is bit i%8 of byte i//8). Opening a shard reads the head alone. Rank adds a block's
directory entry and the bits counted within it, select finds the block in the directory: access, count and locate read and
unpack only the blocks they touch, a bounded number of which is kept.

Shards are rows of a Parquet table in the shared folder (shard, n_docs, n_tokens, payload): written by Spark's
committer, so a lost executor's shards are simply written again. ``write_files`` makes a file of each. Documents are range-dealt by id, so shards ascend.

Edge cases: null text is empty (it still has the end id); null ids come first; repeated ids stay, ordered by text; a very long
text is encoded whole and makes its shard larger; an empty table gives no shards and no rows; other columns, whatever their
names, aren't looked at."""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import chunks, column, text_only
from tessera.llm.tokens import encoder
from tessera.session import map_arrow, stored

END_ID = 2
BLOCK = 4096
KEPT = 512
HEAD = "<4sBQQII"


class WaveletMatrix:
    """Bit planes with rank and select over one shard's ids. ``read(at, size)`` yields bytes of the file; without it the planes are at hand."""

    def __init__(self, n: int, zeros: list[int], ones: list[np.ndarray], doc_ids: np.ndarray, counts: np.ndarray, planes: list[np.ndarray] | None = None, read: Callable | None = None, places: list[tuple[int, np.ndarray]] | None = None):
        self.n, self.zeros, self.ones, self.doc_ids, self.counts = n, zeros, ones, doc_ids, counts
        self.planes, self.read, self.places = planes, read, places
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    @property
    def bits(self) -> int:
        return len(self.zeros)

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (v >> v.dtype.type(k)).astype(np.uint8) & 1
            planes.append(np.packbits(one, bitorder="little"))
            each = [int(np.bitwise_count(planes[-1][a : a + BLOCK]).sum()) for a in range(0, len(planes[-1]), BLOCK)]
            ones.append(np.cumsum([0, *each])[: max(1, len(each))])
            m = one.view(bool)
            low = np.compress(~m, v)
            zeros.append(len(low))
            v = np.concatenate([low, np.compress(m, v)])
        return cls(len(ids), zeros, ones, np.asarray(doc_ids, np.int64), np.asarray(counts, np.uint32), planes)

    def to_bytes(self) -> bytes:
        z = zstandard.ZstdCompressor(level=1)
        table = z.compress(self.doc_ids.astype("<i8").tobytes() + self.counts.astype("<u4").tobytes())
        blocks = [[z.compress(p[a : a + BLOCK].tobytes()) for a in range(0, max(1, len(p)), BLOCK)] for p in self.planes]
        at = struct.calcsize(HEAD) + sum(16 + 4 * (2 * len(x) + 1) for x in blocks) + len(table)
        out = [struct.pack(HEAD, b"WMX2", self.bits, self.n, len(self.doc_ids), BLOCK, len(table))]
        for x, zero, ones in zip(blocks, self.zeros, self.ones, strict=True):
            places = np.cumsum([0, *map(len, x)])
            out += [struct.pack("<QQ", zero, at), places.astype("<u4").tobytes(), ones.astype("<u4").tobytes()]
            at += int(places[-1])
        return b"".join([*out, table, *(c for x in blocks for c in x)])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> WaveletMatrix:
        """A shard by its file's reader: the head and the document table are read, blocks only when needed."""
        head = read(0, struct.calcsize(HEAD))
        if head[:4] != b"WMX2":
            raise ValueError("not a token shard")
        _, bits, n, docs, block, size = struct.unpack(HEAD, head)
        if block != BLOCK:
            raise ValueError(f"blocks of {block} bytes")
        nb = max(1, -(-n // (8 * BLOCK)))
        wide, at = 16 + 4 * (2 * nb + 1), len(head)
        raw = read(at, bits * wide + size)
        zeros, ones, places = [], [], []
        for k in range(bits):
            zero, first = struct.unpack_from("<QQ", raw, k * wide)
            zeros.append(zero)
            places.append((first, np.frombuffer(raw, "<u4", nb + 1, k * wide + 16).astype(np.int64)))
            ones.append(np.frombuffer(raw, "<u4", nb, k * wide + 16 + 4 * (nb + 1)).astype(np.int64))
        table = zstandard.ZstdDecompressor().decompress(raw[bits * wide :], max_output_size=max(1, docs * 12))
        return cls(n, zeros, ones, np.frombuffer(table, "<i8", docs), np.frombuffer(table, "<u4", docs, docs * 8), None, read, places)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        return cls.open(lambda at, size: raw[at : at + size])

    @classmethod
    def from_file(cls, uri: str) -> WaveletMatrix:
        """A shard's file on any file system that Arrow opens (a path or URI)."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        f = system.open_input_file(path)

        def read(at: int, size: int) -> bytes:
            f.seek(at)
            return f.read(size)

        return cls.open(read)

    def _unpacked(self, k: int, first: int, last: int) -> list[np.ndarray]:
        """Blocks first to last (exclusive) of a plane, fetched together."""
        at, places = self.places[k]
        raw = self.read(at + int(places[first]), int(places[last] - places[first]))
        z, a = zstandard.ZstdDecompressor(), places[first]
        return [np.frombuffer(z.decompress(raw[places[b] - a : places[b + 1] - a], max_output_size=BLOCK), np.uint8) for b in range(first, last)]

    def block(self, k: int, b: int) -> np.ndarray:
        if self.planes is not None:
            return self.planes[k][b * BLOCK : (b + 1) * BLOCK]
        if (k, b) in self.kept:
            self.kept.move_to_end((k, b))
        else:
            self.kept[k, b] = self._unpacked(k, b, b + 1)[0]
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        return self.kept[k, b]

    def plane(self, k: int) -> np.ndarray:
        return self.planes[k] if self.planes is not None else np.concatenate(self._unpacked(k, 0, len(self.ones[k])))

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest up."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            m = np.unpackbits(self.plane(k), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~m)] = v[: self.zeros[k]]
            up[np.flatnonzero(m)] = v[self.zeros[k] :] | v.dtype.type(1 << (self.bits - 1 - k))
            v = up
        return v

    @staticmethod
    def _by_block(b: np.ndarray):
        """(block, places in ``b``) for each different block."""
        o = np.argsort(b, kind="stable")
        lead = np.flatnonzero(np.concatenate([[True], b[o][1:] != b[o][:-1]])) if len(o) else []
        for i, s in enumerate(lead):
            yield int(b[o[s]]), o[s : lead[i + 1] if i + 1 < len(lead) else len(o)]

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before position i."""
        out = np.zeros(len(i), np.int64)
        for b, at in self._by_block(np.minimum(i // (8 * BLOCK), len(self.ones[k]) - 1)):
            bits = np.unpackbits(self.block(k, b), bitorder="little")
            within = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            out[at] = self.ones[k][b] + within[i[at] - b * 8 * BLOCK]
        return out

    def access(self, i) -> np.ndarray:
        """Ids at positions."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            r = self._ones(k, i)
            bit = self._ones(k, i + 1) - r
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + r, i - r)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            r = self._ones(k, np.array([lo, hi]))
            lo, hi = (self.zeros[k] + int(r[0]), self.zeros[k] + int(r[1])) if token >> (self.bits - 1 - k) & 1 else (lo - int(r[0]), hi - int(r[1]))
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """Positions of a token, ascending: each occurrence is traced back up through select."""
        a, b = self._range(token, 0, self.n)
        i = np.arange(a, b, dtype=np.int64)
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            i = self._select(k, i - (self.zeros[k] if one else 0), one)
        return i

    def _select(self, k: int, nth: np.ndarray, one: int) -> np.ndarray:
        """Position of the nth (from 0) one or zero of plane k."""
        ahead = self.ones[k] if one else np.arange(len(self.ones[k])) * 8 * BLOCK - self.ones[k]
        out = np.zeros(len(nth), np.int64)
        for b, at in self._by_block(np.searchsorted(ahead, nth, side="right") - 1):
            places = np.flatnonzero(np.unpackbits(self.block(k, b), bitorder="little") == one)
            out[at] = b * 8 * BLOCK + places[nth[at] - ahead[b]]
        return out


def write_shards(docs: DataFrame, path: str | None = None, shard_bytes: int = 8 << 20, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes ``docs`` in ascending id order; returns the shard table as read back. About ``shard_bytes`` of
    text make a shard, which one task holds in memory."""
    src = text_only(docs)
    total = src.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-total // shard_bytes))
    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def build(batches):
        e = encoder(path)
        ids, docs_, null, counts = [], [], 0, []
        for b in batches:
            buf, off = column(b.column(1))
            for i, j in chunks(off, 4 << 20):  # bounds what a task holds beside its batch and shard
                flat, o = e.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                out = np.insert(flat.astype(np.uint32), o[1:], end_id)
                ids.append(out.astype(np.uint16) if not len(out) or out.max() < 65536 else out)
                counts.append(np.diff(o) + 1)
            null += b.column(0).null_count
            docs_.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        if ids and sum(map(len, docs_)):
            w = WaveletMatrix.build(np.concatenate(ids), np.concatenate(docs_), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(w.doc_ids)]), pa.array([null]), pa.array([w.n]), pa.array([w.to_bytes()], pa.binary())], ["shard", "n_docs", "n_null", "n_tokens", "payload"])

    return stored(map_arrow(dealt, build, "shard int, n_docs long, n_null long, n_tokens long, payload binary"), "token-shards")


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """A file of each shard in a folder (path or URI) that the executors share: shard, file and size. A task that runs again puts
    its file in place of the first."""

    def write(batches):
        import uuid

        from pyarrow import fs

        for b in batches:
            files = []
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                uri = f"{folder.rstrip('/')}/shard-{shard:06d}.wmx"
                system, path = fs.FileSystem.from_uri(uri)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(raw.as_buffer())
                system.move(tmp, path)
                files.append((uri, len(raw.as_buffer())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["shard", "file", "size"])

    return stored(map_arrow(shards.select("shard", "payload"), write, "shard int, file string, size long"), "shard-files")


def read_documents(shards: DataFrame) -> DataFrame:
    """shard, doc_id, position of the first id in its shard, n_tokens and the checksum, from the shard blobs."""

    def read(batches):
        for b in batches:
            for shard, null, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = WaveletMatrix.from_bytes(raw.as_py())
                ids = w.decode().astype("<u4")
                n = w.counts.astype(np.int64)
                start = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(start, n, strict=True)]
                doc = pa.array(w.doc_ids, mask=np.arange(len(n)) < null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), doc, pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return map_arrow(shards.select("shard", "n_null", "payload"), read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def global_starts(shards: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before. One row a shard."""
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))


def op2(docs: DataFrame, **options) -> DataFrame:
    shards = write_shards(docs, **options)
    base = global_starts(shards)
    base = F.broadcast(base) if shards.select("shard").count() <= 100_000 else base  # 16 bytes a shard
    return read_documents(shards).join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
