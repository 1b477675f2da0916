"""Best-fit packing of token pieces, after a dominance reduction, on the histogram of their lengths."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Written, driver_bytes

#: A cached part of a text is at most so long, and a worker keeps at most so many.
PART_CHARS, CACHE_PARTS = 48, 600_000
#: Marks that a word may end in, and the first letter whose lower case or composition is not plain.
PUNCTUATION, MOST_LETTER = ".,;:!?*#$%&|-_()[]{}\"", "\u0130"


class PartEncoder(dict):
    """Token ids of a text as little-endian bytes, four an id.

    The vocabulary's pre-tokenizer drops white space and never joins what a space or line end parts, so parts
    between them are encoded by the library and remembered: self maps a part to its ids. A part that is a Latin word
    and punctuation is put together from both, the word in lower case, as the vocabulary's normalizer does.
    """

    def __init__(self, vocabulary: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.library = Tokenizer.from_buffer(vocabulary)
        self.words: dict[str, bytes] = {"": b""}
        self.plain = self.encoded("Ab.") == self.encoded("ab") + self.encoded(".")

    def encoded(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)  # for a few ids much cheaper than an array of numpy

    def word(self, text: str) -> bytes:
        if (ids := self.words.get(text)) is None:
            if len(self.words) >= CACHE_PARTS:
                self.words.clear()
            ids = self.words[text] = self.encoded(text)
        return ids

    def __missing__(self, part: str) -> bytes:
        if len(part) > PART_CHARS:
            return self.encoded(part)
        core = part.rstrip(PUNCTUATION)
        if self.plain and core.isalpha() and max(core) < MOST_LETTER:
            ids = self.word(core.lower()) + (self.word(part[len(core) :]) if len(core) < len(part) else b"")
        else:
            ids = self.encoded(part)
        if len(self) >= CACHE_PARTS:
            self.clear()
        self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: Encoders of this worker process, by vocabulary: a reused worker keeps what it has learnt.
_encoders: dict[int, PartEncoder] = {}


def encoder_of(vocabulary: bytes) -> PartEncoder:
    key = zlib.crc32(vocabulary)
    if key not in _encoders:
        _encoders[key] = PartEncoder(vocabulary)
    return _encoders[key]


class Plan:
    """Where pieces go, by length and rank among the pieces of that length.

    Rows are (length, first rank, pieces, first sequence, pieces a sequence, offset): pieces of one length with
    consecutive ranks fill consecutive sequences, so the plan's size follows the capacity, not the corpus.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < n <= capacity for n in counts):
            raise ValueError("a length is outside 1..capacity")
        self.capacity, self.left, self.rank = capacity, {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.reduce()
        self.best_fit()

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], n, sequence, each, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], times: int) -> None:
        """So many sequences, each of exactly these pieces."""
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            self.put(n, each * times, self.sequences, each, offset)
            offset += each * n
        self.sequences += times

    def smallest(self, k: int) -> list[int]:
        """Of the k smallest pieces left."""
        found: list[int] = []
        for n in sorted(self.left):
            found += [n] * min(self.left[n], k - len(found))
            if len(found) == k:
                break
        return found

    def reduce(self) -> None:
        """Martello-Toth: fix sets of up to three pieces that dominate every other set with their largest piece."""
        changed = True
        while changed:
            changed = False
            for j in sorted(self.left, reverse=True):
                while j in self.left and (s := self.dominant(j)):
                    self.fix(s, min(self.left[n] // s.count(n) for n in set(s)))
                    changed = True

    def dominant(self, j: int) -> list[int] | None:
        room = self.capacity - j
        self.left[j] -= 1
        try:
            rest = sorted(n for n, c in self.left.items() if c and n <= room)
            if not rest:
                return [j]
            k = rest[-1]
            if k == room:  # nothing can be worth more than a full sequence with one partner
                return [j, k]
            low: list[int] = []
            for n in rest[:3]:
                low += [n] * min(self.left[n], 3 - len(low))
                if len(low) == 3:
                    break
            if len(low) < 2 or low[0] + low[1] > room:  # one partner at most: the largest
                return [j, k]
            if len(low) == 3 and sum(low) <= room:  # three partners fit; sets this large are not compared
                return None
            best, second = (0, 0, 0), 0
            for a in rest:  # the best pair, and the largest smaller member of any pair
                b = rest[max(0, self.at_most(rest, room - a))]
                if a + b > room or a == b and self.left[a] < 2:
                    b = next((x for x in reversed(rest) if x + a <= room and (x != a or self.left[a] > 1)), 0)
                if b:
                    best, second = max(best, (a + b, max(a, b), min(a, b))), max(second, min(a, b))
            if k >= best[0]:  # any pair fits into the place of the single partner
                return [j, k]
            if best[1] == k and best[2] >= second:  # any pair fits member by member into this one
                return [j, best[1], best[2]]
            return None
        finally:
            self.left[j] += 1

    @staticmethod
    def at_most(values: list[int], most: int) -> int:
        return bisect_left(values, most + 1) - 1

    def best_fit(self) -> None:
        """Best-fit decreasing, a whole class of equal pieces and equal rooms at a time."""
        rooms: list[int] = []
        spare: dict[int, list[tuple[int, int]]] = {}

        def give(room: int, sequence: int, n: int) -> None:
            if room and n:
                if room not in spare:
                    spare[room] = []
                    insort(rooms, room)
                spare[room].append((sequence, n))

        for length in sorted(self.left, reverse=True):
            while c := self.left.get(length, 0):
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, n = spare[room].pop()
                    if not spare[room]:
                        del spare[room], rooms[at]
                else:
                    room, n = self.capacity, -(-c // (self.capacity // length))
                    sequence = self.sequences
                    self.sequences += n
                each = min(room // length, c)
                used = min(n, c // each)
                self.put(length, used * each, sequence, each, self.capacity - room)
                give(room - each * length, sequence, used)
                give(room, sequence + used, n - used)


def pack_plan(counts: dict[int, int], capacity: int) -> Plan:
    return Plan(counts, capacity)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece, packed into few sequences.

    A document is the vocabulary's ids of its whole text and then end_id; only a longer one is cut, into pieces
    of capacity ids. A null text counts as empty and still has its end id; a null id stays null; repeated rows
    are packed each; other columns are ignored; an empty table gives no rows.

    Text is read once and never moves: a scan leaves some fifty bytes a piece in the shared folder. Packing
    sees lengths alone: their histogram has at most capacity rows, wherever the corpus ends, and the
    plan made from it names rank ranges. A piece's rank is its place among its task's pieces of that length, counted
    in the scan, plus the counts of the tasks before, a window over one row for each task and length.
    """
    spark = docs.sparkSession
    vocabulary = driver_bytes(spark, tokenizer_path)
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = encoder_of(vocabulary.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[int, int, int, int, int, int]] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        n = len(part) // 4
                        rows.append((i, piece, start, n, zlib.crc32(part), int(seen[n])))
                        seen[n] += 1
                if rows:
                    i, *columns = map(pa.array, zip(*rows, strict=True))
                    piece, start, n, crc, rank = columns
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(i), piece.cast(pa.int32()), start, n, crc, rank, pa.array([task] * len(rows), pa.int32())], names=["id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    cut_type = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, rank long, task int"
    pieces = Written(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(cut, cut_type), "pieces").df
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = pack_plan(histogram, capacity)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    places = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places.value
        top = int(rows[:, 1].max()) + int(rows[:, 2].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * top + rows[:, 1] if capacity * top < 1 << 62 else None
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            if keys is not None:
                at = np.searchsorted(keys, n * top + rank, "right") - 1
            else:
                first = np.searchsorted(rows[:, 0], n)
                last = np.searchsorted(rows[:, 0], n, "right")
                at = np.array([f + np.searchsorted(rows[f:z, 1], r, "right") - 1 for f, z, r in zip(first, last, rank, strict=True)], np.int64)
            found = rows[at]
            turn = rank - found[:, 1]
            sequence, offset = found[:, 3] + turn // found[:, 4], found[:, 5] + turn % found[:, 4] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.alias("p").join(before.select("length", "task", "before").alias("c"), ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
