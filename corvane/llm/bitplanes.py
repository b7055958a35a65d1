"""Token ids in binary files: blocks of ids transposed into byte or bit planes, each plane compressed on its own.

A shard file is

    magic | chunk planes ... | zstd(document table) | footer | length of footer (4 bytes) | magic

A chunk holds up to CHUNK ids as unsigned 32-bit integers. Its ids are transposed into 4 byte planes (or 32 bit
planes), from the lowest up, and every plane is compressed with zstandard; a plane of zeros takes no bytes. The footer
(JSON) is the chunk index: ids per chunk and bytes per plane. The document table has the id, a null flag and the number
of token ids of each document, in the order of the file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side

MAGIC = b"CVPLANE1"
CHUNK = 1 << 16
#: Ids after which a shard is closed; a document is never split over shards.
SHARD_IDS = 1 << 21
END_ID = 2


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of uint32 ids, lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if mode == "byte":
        return [r.tobytes() for r in rows]
    bits = np.unpackbits(np.ascontiguousarray(rows), axis=1, bitorder="little").reshape(4, -1, 8)
    return [np.packbits(bits[b, :, k], bitorder="little").tobytes() for b in range(4) for k in range(8)]


def from_planes(planes: list[bytes | None], n: int, mode: str) -> np.ndarray:
    """The inverse; a missing plane is all zeros."""
    if mode == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        if p:
            ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


def pack(docs: list[tuple[int | None, np.ndarray]], mode: str = "byte", chunk: int = CHUNK) -> bytes:
    """A shard file of documents (id, token ids)."""
    zc = zstandard.ZstdCompressor(level=1)
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    parts, index = [MAGIC], []
    for at in range(0, len(ids), chunk):
        block = ids[at : at + chunk]
        planes = [zc.compress(p) if any(p) else b"" for p in to_planes(block, mode)]
        parts += planes
        index.append([len(block), [len(p) for p in planes]])
    table = zc.compress(
        np.array([d or 0 for d, _ in docs], "<i8").tobytes()
        + np.array([d is None for d, _ in docs], np.uint8).tobytes()
        + np.array([len(x) for _, x in docs], "<i8").tobytes()
    )
    footer = json.dumps({"mode": mode, "docs": len(docs), "table": len(table), "chunks": index}).encode()
    return b"".join([*parts, table, footer, struct.pack("<I", len(footer)), MAGIC])


def unpack(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents (id, token ids) of a shard file, in order; raises ValueError if it is damaged."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a plane file")
    zd = zstandard.ZstdDecompressor()
    end = len(data) - len(MAGIC) - 4
    (size,) = struct.unpack_from("<I", data, end)
    meta = json.loads(data[end - size : end])
    n = meta["docs"]
    table = zd.decompress(data[end - size - meta["table"] : end - size])
    keys, null, lens = np.frombuffer(table, "<i8", n), np.frombuffer(table, np.uint8, n, 8 * n), np.frombuffer(table, "<i8", n, 9 * n)
    at, blocks = len(MAGIC), []
    for m, sizes in meta["chunks"]:
        planes: list[bytes | None] = []
        for s in sizes:
            planes.append(zd.decompress(data[at : at + s]) if s else None)
            at += s
        blocks.append(from_planes(planes, m, meta["mode"]))
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    if len(ids) != lens.sum():
        raise ValueError("document table and chunks differ")
    ends = np.cumsum(lens)
    for k, nul, e, m in zip(keys.tolist(), null.tolist(), ends.tolist(), lens.tolist(), strict=True):
        yield (None if nul else k), ids[e - m : e]


#: Characters that end a pre-token as white space, in the tokenizer's own pattern (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that certainly end a pre-token before an ASCII character that is no letter.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Distinct pieces whose ids are remembered; the memory is emptied when it is full, so it stays bounded.
REMEMBER = 1_000_000


class Encoder:
    """Text to token ids with the tokenizers library.

    The tokenizer never merges over the edge of a pre-token. Texts are cut at edges that are certain (white space, and
    Latin letters before ASCII characters that are none), and each distinct piece goes through the library once. Texts
    with the string of a special or added token, which the library finds before it cuts, go through it as a whole. Tasks
    are the parallelism, so the library runs in one thread.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else (lambda text: None)
        piece = f" ?[{LATIN}]++(?![^\\x00-\\x7f])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        self.cut = re.compile(piece).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if self.added(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        pieces, known = self.cut(text), self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = list(set(pieces))
            for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), "<u4")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, once per Python worker."""
    return Encoder(path)


def write_shards(spark: SparkSession, docs: DataFrame, root: str, tokenizer: str, mode: str = "byte") -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into shard files under ``root``; one row per shard.

    Documents are dealt into ranges of doc_id and sorted there, so shard names sort as ids do. A shard appears under
    its name by a rename, and a repeated task writes the same bytes, so lost executors do no harm. Memory per task is
    one shard. The returned DataFrame does the work when it is written.
    """
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs
        from pyspark import TaskContext

        store, base = pfs.FileSystem.from_uri(root)
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        held: list[tuple[int | None, np.ndarray]] = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            name = f"shard-{part:06d}-{seq:06d}.cvp"
            tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(tmp) as out:
                out.write(pack(held, mode))
            store.move(tmp, f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(held)], "n_ids": [size]})
            held, size, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                held.append((key, ids))
                size += len(ids)
                if size >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    return dealt.mapInArrow(run, "shard string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all shards under ``root``: shard, doc_id, at (ids of the shard before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, at, n, crc, pos = [], [], [], [], 0
                for key, ids in unpack(data.as_py()):
                    keys.append(key)
                    at.append(pos)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    pos += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[-1]] * len(keys)), *(pa.array(x, pa.int64()) for x in (keys, at, n, crc))],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.cvp").load(root).select("path", "content")
    return files.mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, mode: str = "byte") -> DataFrame:
    """Write ``docs`` as shard files in the shared folder, read them back, and describe each document.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32, shard. Null and
    empty texts have the end id alone. Documents are ordered by doc_id, nulls first; repeated doc_ids follow one
    another in an order fixed by their texts, and each has its own row. An empty table gives no files and no rows.
    Columns other than doc_id and text are not looked at.
    """
    scratch = Scratch(spark, "tokens")
    root = scratch.path("shards")
    jvm = spark.sparkContext._jvm
    scratch._fs.mkdirs(jvm.org.apache.hadoop.fs.Path(root))
    shards = scratch.save(write_shards(spark, docs, root, tokenizer, mode), "manifest")
    # one row per shard of two million ids: small enough to be ordered as a whole
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("shard", first.alias("base"))
    found = read_shards(spark, root).join(small_side(starts), "shard")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
