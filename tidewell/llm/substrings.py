"""Exact substring dedup by fixed-block anchors, rolling probes and extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Written, release

#: Words in a chunk of documents, and probes that meet in a bucket, about.
CHUNK_WORDS, BUCKET_PROBES = 1_500_000, 3_000_000
NO_ID = np.iinfo(np.int64).max
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= MULTIPLIER
        out += words[i : i + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


class Chunk:
    """Documents of one chunk: ids, their words, and hashes of runs of words inside a document."""

    def __init__(self, ids: np.ndarray, blob: bytes):
        self.ids = ids
        texts = zstandard.decompress(blob).split(b"\0\n")[:-1] if len(ids) else []
        # a zero byte and a line end inside a text were parted when the chunk was made
        self.words = [t.replace(b"\0 ", b"\0").split() for t in texts]
        self.size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((h for ws in self.words for h in map(digest, ws)), np.uint64, int(self.size.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.size)
        self.first = np.cumsum(self.size) - self.size

    @staticmethod
    def blob(texts: list[bytes]) -> bytes:
        return zstandard.compress(b"".join(t.replace(b"\0", b"\0 ") + b"\0\n" for t in texts), 3)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k words of one document start, and their hashes."""
        rolled = _rolled(self.hashes, k)
        at = np.flatnonzero(self.doc[: len(rolled)] == self.doc[k - 1 :]) if len(rolled) else np.zeros(0, np.int64)
        return at, rolled[at]


def _ends(n: int, values: np.ndarray, shift: int) -> np.ndarray:
    """Where each of n runs of equal high bits ends among sorted values."""
    return np.searchsorted(values >> np.uint64(shift), np.arange(n, dtype=np.uint64), "right") if shift < 64 else np.array([len(values)])


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words of repeats of at least window words.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on the
    input. kept has the other words, a space between. A null text has no words. A null id is larger than any other:
    such a document never takes words from others. Rows that share an id never take words from each other. Other
    columns are ignored; an empty table gives no rows.

    Reference blocks are each document's non-overlapping runs of (window + 1) / 2 words: any window contains one of
    the document it is in. Every rolling run of that length probes them. Documents are packed
    into chunks; a chunk sends four bytes a probe to the bucket of its hash, and gets back which probes hit a block that also occurs
    elsewhere. Only hits are extended, to the windows around them, whose exact keys find their smallest
    document in the same way; overlapping windows make maximal repeats. A run that a chunk holds often is
    sent once, and no pair of documents is ever formed, so a passage that every document shares costs one entry a chunk.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        kind = [("chunk", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("blob", pa.binary()), ("probes", pa.int64())]

        def flush() -> pa.RecordBatch:
            null = np.array([i is None for i in ids])
            row = [task << 32 | made, np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(), np.packbits(null).tobytes(), Chunk.blob(texts), held]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, kind, strict=True)], schema=pa.schema(kind))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t.encode("utf-8", "surrogatepass") if t else b"")
                held += len(texts[-1]) // 6 + 1
                if held >= CHUNK_WORDS:
                    yield flush()
                    made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield flush()

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    chunks = Written(source.mapInArrow(pack, "chunk long, ids binary, nulls binary, blob binary, probes long"), "chunks").df
    total = chunks.agg(F.sum("probes")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total / BUCKET_PROBES)))))
    buckets, shift = 1 << bits, 64 - bits

    def chunk_of(row: dict) -> Chunk:
        return Chunk(np.frombuffer(row["ids"], np.int64), row["blob"])

    def by_chunk(b: pa.RecordBatch) -> Iterator[dict]:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]

    def probes(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct run hashes; place in them of each run; whether a hash occurs twice; whether one is a block; the runs' places."""
        at, rolled = c.runs(block)
        value, inverse, count = np.unique(rolled, return_inverse=True, return_counts=True)
        aligned = np.zeros(len(value), bool)
        aligned[inverse[(at - c.first[c.doc[at]]) % block == 0]] = True
        return value, inverse, count > 1, aligned, at

    def send_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in by_chunk(b):
                value, _, twice, aligned, _ = probes(chunk_of(row))
                ends, rows, begin = _ends(buckets, value, shift), [], 0
                low = (value >> np.uint64(max(0, shift - 32))).astype(np.uint32)
                for k, end in enumerate(ends.tolist()):
                    if end > begin:
                        s = slice(begin, end)
                        rows.append((k, row["chunk"], low[s].tobytes(), np.packbits(twice[s]).tobytes(), np.packbits(aligned[s]).tobytes()))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "low", "twice", "aligned"])

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def unpacked(data: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)

    def match_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            low = [np.frombuffer(r["low"], np.uint32) for r in rows]
            value, inverse, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
            again, anchor = count > 1, np.zeros(len(value), bool)
            again[inverse[np.concatenate([unpacked(r["twice"], len(v)) for r, v in zip(rows, low, strict=True)])]] = True
            anchor[inverse[np.concatenate([unpacked(r["aligned"], len(v)) for r, v in zip(rows, low, strict=True)])]] = True
            hit, at, out = (again & anchor)[inverse], 0, []
            for r, v in zip(rows, low, strict=True):
                if (found := np.flatnonzero(hit[at : at + len(v)])).size:
                    out.append((r["chunk"], r["bucket"], found.astype(np.uint32).tobytes()))
                at += len(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "hits"])

    sent = chunks.select("chunk", "ids", "blob").mapInArrow(send_probes, "bucket int, chunk long, low binary, twice binary, aligned binary")
    hits = Written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(match_probes, "chunk long, bucket int, hits binary"), "hits").df
    release(spark)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in by_chunk(b):
                c = chunk_of(row)
                value, inverse, _, _, at = probes(c)
                hit, begins = np.zeros(len(value), bool), np.r_[0, _ends(buckets, value, shift)]
                for x in row["found"]:
                    hit[begins[x["bucket"]] + np.frombuffer(x["hits"], np.uint32)] = True
                near = np.zeros(len(c.hashes) + window, np.int64)  # extend: windows that hold a run which hits
                place = at[hit[inverse]]
                np.add.at(near, np.maximum(place - (window - block), 0), 1)
                np.add.at(near, place + 1, -1)
                start, key = c.runs(window)
                chosen = np.cumsum(near)[start] > 0
                start, key = start[chosen], key[chosen]
                ids = c.ids[c.doc[start]]
                order = np.lexsort((ids, key))
                key, ids = key[order], ids[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(key)] - 1
                key, low, several = key[first], ids[first], ids[first] != ids[last]
                rows, begin = [], 0
                for k, end in enumerate(_ends(buckets, key, shift).tolist()):
                    if end > begin:
                        s = slice(begin, end)
                        rows.append((k, row["chunk"], key[s].tobytes(), zstandard.compress(low[s].tobytes(), 1), np.packbits(several[s]).tobytes()))
                    begin = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "keys", "low", "several"])

    def match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            value, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            low = np.concatenate([np.frombuffer(zstandard.decompress(r["low"]), np.int64) for r in rows])
            least = np.full(len(value), NO_ID)
            np.minimum.at(least, inverse, low)
            want = (least[inverse] < low) | np.concatenate([unpacked(r["several"], len(k)) for r, k in zip(rows, keys, strict=True)])
            at, out = 0, []
            for r, k in zip(rows, keys, strict=True):
                s = slice(at, at + len(k))
                if want[s].any():
                    out.append((r["chunk"], r["bucket"], k[want[s]].tobytes(), zstandard.compress(least[inverse[s]][want[s]].tobytes(), 1)))
                at += len(k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "keys", "least"])

    found = hits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hits")).alias("found"))
    near = chunks.select("chunk", "ids", "blob").join(found, "chunk").mapInArrow(send_windows, "bucket int, chunk long, keys binary, low binary, several binary")
    repeats = Written(near.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(match_windows, "chunk long, bucket int, keys binary, least binary"), "repeats").df
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in by_chunk(b):
                c = chunk_of(row)
                gone = np.zeros(len(c.hashes), bool)
                if row["found"]:
                    parts = sorted(row["found"], key=lambda x: x["bucket"])
                    keys = np.concatenate([np.frombuffer(x["keys"], np.uint64) for x in parts])
                    least = np.concatenate([np.frombuffer(zstandard.decompress(x["least"]), np.int64) for x in parts])
                    start, key = c.runs(window)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    start = start[(keys[at] == key) & (least[at] < c.ids[c.doc[start]])]
                    cover = np.zeros(len(c.hashes) + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                removed = np.add.reduceat(np.r_[gone, False], np.minimum(c.first, len(gone)), dtype=np.int64) * (c.size > 0) if len(c.size) else c.size
                null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(c.ids)).astype(bool)
                for a in range(0, len(c.ids), 500):
                    z, kept = min(a + 500, len(c.ids)), []
                    for i in range(a, z):
                        words = c.words[i]
                        if removed[i]:
                            words = [w for w, g in zip(words, gone[c.first[i] : c.first[i] + c.size[i]].tolist(), strict=True) if not g]
                        kept.append(b" ".join(words))
                    yield pa.RecordBatch.from_arrays([pa.array(c.ids[a:z], mask=null[a:z]), pa.array(c.size[a:z]), pa.array(removed[a:z]), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    answers = repeats.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys", "least")).alias("found"))
    return chunks.select("chunk", "ids", "nulls", "blob").join(answers, "chunk", "left").mapInArrow(cut, f"`{id_col}` long, n_words long, n_removed long, kept string")
