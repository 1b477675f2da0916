"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.common import driver_bytes

#: The byte-level pre-tokenizer's pattern, as the vocabulary's library publishes it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: A cached part of a text is at most so long, and a worker keeps at most so many.
PART_CHARS, CACHE_PARTS = 64, 500_000
#: Fields of a heap entry: the merged symbol in 20 bits, the place in 40, the rank above.
SYMBOL, PLACE = (1 << 20) - 1, (1 << 40) - 1


def _byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of byte-level BPE text; no token identifiers are made."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letters = _byte_letters()
        symbol: dict[bytes, int] = {bytes([b]): b for b in range(256)}

        def of(letters_of_symbol: str) -> bytes:
            return bytes(letters[c] for c in letters_of_symbol)

        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(of, pair.split(" ") if isinstance(pair, str) else pair)
            for s in (left, right, left + right):
                symbol.setdefault(s, len(symbol))
            self.merges.setdefault(symbol[left] << 32 | symbol[right], (rank + 1) << 60 | symbol[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.odd = regex.compile(r"[^\S\n ]|[\x1c-\x1f\x85᠎​]|[ \n][ \n]|^[ \n]|[ \n]$")
        self.cache: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece: its bytes less the merges, lowest rank first, leftmost first among equals."""
        symbols = list(text.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        merges = self.merges.get
        # an entry holds rank, place and the merged symbol in one number, so that they compare at machine speed
        heap = []
        for i in range(n - 1):
            if found := merges(symbols[i] << 32 | symbols[i + 1]):
                heap.append(found | i << 20)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, merged = entry >> 20 & PLACE, entry & SYMBOL
            j = after[i]
            if j >= n or symbols[i] < 0 or merges(symbols[i] << 32 | symbols[j], -1) | i << 20 != entry:
                continue
            symbols[i], symbols[j] = merged, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges(merged << 32 | symbols[k]):
                    heapq.heappush(heap, found | i << 20)
            if (h := before[i]) >= 0 and (found := merges(symbols[h] << 32 | merged)):
                heapq.heappush(heap, found | h << 20)
        return left

    def short(self, text: str) -> int:
        """Tokens of one piece; a short one is remembered."""
        found = self.known.get(text)
        if found is None:
            found = self.piece(text)
            if len(text) <= PART_CHARS:
                if len(self.known) >= CACHE_PARTS:
                    self.known.clear()
                self.known[text] = found
        return found

    def pieces_of(self, text: str) -> int:
        return sum(map(self.short, self.pieces.findall(text)))

    def part(self, text: str) -> int:
        """Tokens of a text whose ends are piece boundaries; short ones are remembered."""
        found = self.cache.get(text)
        if found is None:
            found = self.pieces_of(text)
            if len(text) <= PART_CHARS:
                if len(self.cache) >= CACHE_PARTS:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def plain(self, text: str) -> int:
        """Single spaces and line ends between words are piece boundaries, so parts between them are counted once and remembered."""
        if not text or self.odd.search(text):
            return self.pieces_of(text)
        lines = text.split("\n")
        cache, part, total = self.cache, self.part, len(lines) - 1
        for line in lines:
            first, *rest = line.split(" ")
            total += part(first)
            for w in rest:
                w = " " + w
                n = cache.get(w)
                total += part(w) if n is None else n
        return total


#: Counters of this worker process, by vocabulary: a reused worker keeps what it has learnt.
_counters: dict[int, MergeCounter] = {}


def counter_of(vocabulary: bytes) -> MergeCounter:
    key = zlib.crc32(vocabulary)
    if key not in _counters:
        _counters[key] = MergeCounter(vocabulary)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, its whole text counted.

    tokenizer_path names a byte-level BPE vocabulary in the tokenizers library's JSON form. A null text
    counts as empty; a null id stays null; repeated rows give repeated results; other columns are ignored,
    whatever their names. Rows never move: the plan has no shuffle, and each worker holds one Arrow batch,
    one text's heap and a cache of bounded size.
    """
    vocabulary = driver_bytes(docs.sparkSession, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
