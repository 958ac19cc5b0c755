"""Token ids in fixed-width bit packing, with random access by block.

File format (little-endian), one file per range of the document order::

    magic  b"MXPK" | version u16 | bits u16 | docs u64 | ids u64 | blocks u64
    document offsets   (docs + 1) x u64        first id of each document
    block offsets      (blocks + 1) x u64      byte offset of each block in the payload
    payload            blocks of BLOCK_IDS ids, each id in ``bits`` bits, least bit first

Every block but the last holds BLOCK_IDS ids, a multiple of 64, so blocks start on bytes
and id i lies in block i // BLOCK_IDS at bit (i % BLOCK_IDS) * bits.

The files are cells of a Parquet table (file_no, body): any store that Spark writes will
do, and a lost executor's files are written again under Spark's commit protocol.
Documents are range-partitioned by doc_id (equal ids by a hash of the text too, so one
doc_id cannot fill a task), and only per-range totals meet in one place.

Cases: null or empty text encodes to the end id alone.  Null doc_ids come first.  Equal
doc_ids are ordered by a hash of their text, then by text.  An empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import stash

MAGIC = b"MXPK"
HEAD = struct.Struct("<4sHHQQQ")
BLOCK_IDS = 4096
#: Ids of one file, about; a longer document makes a longer file.
FILE_IDS = 1 << 20
#: Distinct units whose ids a worker remembers (about 40 bytes each).
CACHE = 1_500_000
#: Ranges of the document order at most: bounds the one broadcast, of their totals.
MAX_PARTS = 1 << 19


def bits_for(vocabulary: int) -> int:
    """Least bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(out.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")[: n * bits]
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_file(ids: np.ndarray, first: np.ndarray, bits: int) -> bytes:
    """A file of the documents whose ids lie between neighbours of ``first``."""
    n = -(-len(ids) // BLOCK_IDS)
    parts = [pack(ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS], bits) for i in range(n)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u8")
    return HEAD.pack(MAGIC, 1, bits, len(first) - 1, len(ids), n) + first.astype("<u8").tobytes() + at.tobytes() + b"".join(parts)


class PackedFile:
    """Random access to one file's documents."""

    def __init__(self, body: bytes):
        magic, version, self.bits, self.docs, self.ids, self.blocks = HEAD.unpack_from(body)
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed id file")
        self.first = np.frombuffer(body, "<u8", self.docs + 1, HEAD.size).astype(np.int64)
        at = HEAD.size + 8 * (self.docs + 1)
        self.block_at = np.frombuffer(body, "<u8", self.blocks + 1, at).astype(np.int64)
        self.payload = memoryview(body)[at + 8 * (self.blocks + 1) :]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop): only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        lo, hi = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS + 1
        n = min(hi * BLOCK_IDS, self.ids) - lo * BLOCK_IDS
        got = unpack(self.payload[self.block_at[lo] : self.block_at[hi]], n, self.bits)
        return got[start - lo * BLOCK_IDS : stop - lo * BLOCK_IDS]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.first[i]), int(self.first[i + 1]))


_encoders: dict[str, Encoder] = {}


def _cuts() -> np.ndarray:
    """Places between two ASCII bytes where any pre-tokenizer that keeps letters, single
    digits and marks apart splits: between their classes and between digits; never next
    to an apostrophe (contractions) or a bar (special tokens)."""
    kind = np.zeros(128, dtype=np.int8)
    kind[33:127] = 3
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    kind[[39, 124]] = 0
    x, y = kind[:, None], kind[None, :]
    out = np.zeros((256, 256), dtype=bool)
    out[:128, :128] = (x > 0) & (y > 0) & ((x != y) | (x == 2))
    return out.ravel()


class Encoder:
    """Ids of whole texts, unit by unit.  Units are white-space-free runs, cut further
    where the tokenizer splits anyway; they repeat, so a worker remembers their ids.

    That a tokenizer allows this is probed once: with cuts, without them, and if neither
    gives the ids of whole texts, each text is encoded whole.  Units are told apart by a
    64-bit hash (of folded letters, if the tokenizer folds them)."""

    PROBES = ("a b\nc  d", " the\tcat's é x\r\ny 12,5 ", "中文 #1! (don't) x=3|y <|endoftext|>z", "Word.Next-one's $$$ a...b\u00e9! 3.14e10 a_b", "e\u0301 A\u030a+1 \u201cq\u201d, 'll 've 'S")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.folds = all(self._whole(p) == self._whole(p.lower()) for p in ("Ab CD ef", "HELLO World X"))
        whole = [np.array(self._whole(p), np.uint32) for p in self.PROBES]
        for self.cut in (_cuts(), None):
            self._forget()
            self.plain = False
            got = [self.batch(*T.buffers(pa.array([p])), 0)[0][:-1] for p in self.PROBES]
            self.plain = not all(np.array_equal(a, b) for a, b in zip(whole, got, strict=True))
            if not self.plain:
                break

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, words: T.Words, h: np.ndarray, where: np.ndarray) -> None:
        """Remember the ids of units not known yet."""
        own = [e.ids for i in range(0, len(where), 20_000) for e in self.tok.encode_batch_fast([words.bytes_at(k).decode() for k in where[i : i + 20_000]], add_special_tokens=False)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((x for o in own for x in o), np.uint32, int(size.sum()))])
        h = np.concatenate([self.known, h])
        by = np.argsort(h, kind="stable")
        self.known, self.at, self.size = h[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of h among the known; -1 if it is not there."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def batch(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each document and the end) of a slice of documents."""
        d = len(bounds) - 1
        if self.plain:
            raw = data.tobytes()
            own = [np.array([*e.ids, end_id], np.uint32) for e in self.tok.encode_batch([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        words = T.words_of(data, bounds, T.NONSPACE, self.cut)
        h = words.hash
        if len(h):
            caps = self._caps(data, words)
            if self.folds:  # but special tokens, which hold a bar
                bars = np.append(0, np.cumsum(data == 124))
                caps[bars[words.end] == bars[words.start]] = 0
            h = np.where(caps > 0, T.mix64(h ^ T.mix64(caps)), h)
        once, first, which = np.unique(h, return_index=True, return_inverse=True)
        new = self._find(once) < 0
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE:
                self._forget()
                new[:] = True
            self._learn(words, once[new], first[new])
        place = self._find(once)[which] if len(h) else np.zeros(0, np.int64)
        n, head = self.size[place], self.at[place]
        per_doc = np.bincount(words.doc, weights=n, minlength=d).astype(np.int64) + 1
        starts = np.concatenate([[0], np.cumsum(per_doc)])
        ids = np.full(starts[-1], end_id, dtype=np.uint32)
        total = int(n.sum())
        if total:
            run = np.arange(total)
            ids[run + np.repeat(words.doc, n)] = self.flat[run + np.repeat(head - (np.cumsum(n) - n), n)]
        return ids, starts

    @staticmethod
    def _caps(data: np.ndarray, words: T.Words) -> np.ndarray:
        """Hash of the places of capitals within each unit; 0 if it has none."""
        up, down = T._power(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(((data >= 65) & (data <= 90)) * up[: len(data)], dtype=np.uint64)])
        return (total[words.end] - total[words.start]) * down[words.start]


def _texts(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    n = min(MAX_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    return own.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").select("doc_id", "text")


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The packed files of ``docs`` in ascending doc_id order, as a stashed table:
    part (range of the order), file_no and before (files and ids of the part before this
    file), n_ids, doc_ids, body."""
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @T.tidy
    def scan(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, file_no = Encoder.of(tokenizer), 0
        before = 0
        ids, docs_, firsts, held = [], [], [], 0

        def flush():
            nonlocal ids, docs_, firsts, held, file_no, before
            sizes = np.concatenate(firsts)
            first = np.concatenate([[0], np.cumsum(sizes)])
            names = pa.concat_arrays(docs_)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file_no], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([encode_file(np.concatenate(ids), first, bits)], pa.binary())],
                ["part", "file_no", "before", "n_ids", "doc_ids", "body"],
            )
            file_no += 1
            before += held
            ids, docs_, firsts, held = [], [], [], 0
            return row

        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            for i, j in T.slices(bounds, 2 << 20):
                got, first = enc.batch(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], end_id)
                ids.append(got)
                firsts.append(np.diff(first))
                docs_.append(batch.column("doc_id").slice(i, j - i))
                held += len(got)
                if held >= FILE_IDS:
                    yield flush()
        if docs_:
            yield flush()

    return stash(_texts(docs).mapInArrow(scan, f"part int, file_no long, before long, n_ids long, doc_ids array<{kind}>, body binary"), "packed")


def placed(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the ids of all files before.  Only one total per range of
    the order (a Spark partition; at most MAX_PARTS of 16 bytes) meets in one task."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("__ahead"))
    return files.join(F.broadcast(ahead), "part").withColumn("start", F.col("before") + F.col("__ahead"))


def read(files: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32, in no order."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    @T.tidy
    def scan(batches):
        for batch in batches:
            for k in range(len(batch)):
                f = PackedFile(batch.column("body")[k].as_py())
                start = batch.column("start")[k].as_py()
                names = batch.column("doc_ids")[k].values
                ids = f.read(0, f.ids).astype("<u4")
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(f.first[:-1], f.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(start + f.first[:-1], pa.int64()), pa.array(np.diff(f.first), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(files).select("start", "doc_ids", "body").mapInArrow(scan, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> int:
    """Write the cells as plain files to a folder that executors share (a local path)."""
    import os

    os.makedirs(folder, exist_ok=True)

    def put(row):
        with open(f"{folder}/{row.part:06d}-{row.file_no:06d}.mxpk", "wb") as out:
            out.write(row.body)

    files.foreach(put)
    return files.count()


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` in the packed format and read the files back."""
    return read(write(docs, tokenizer, end_id))
