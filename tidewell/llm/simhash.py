"""SimHash near-duplicates by a Gray-order hierarchical index of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Written
from tidewell.llm.components import connected_components

BITS, SEED = 64, 42
#: Children of an index node; queries searched at once; codes under one root before it is parted again; codes of small roots handled together.
FAN_OUT, QUERIES, ROOT_CODES, CHUNK = 8, 1024, 4096, 20_000


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included; a text with fewer words is one shingle, without words zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(words_each, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        ones += np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(id long, fp long): each row's fingerprint, as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t, words_each) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=["id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(of, "id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


class GrayIndex:
    """Codes in Gray order under one root for each key; a node holds the bits that all its codes share.

    A node's mask has the shared bits and its pattern their values. A child's mask holds its parent's, so only
    its further bits are compared, and differences add up on the way down; a node beyond most is left out with all below it.
    """

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), keys))
        key, self.codes = keys[self.order], codes[self.order]
        n = len(key)
        self.levels = [(np.full(n, ~np.uint64(0)), self.codes, np.arange(n), np.arange(n) + 1, np.arange(n))]
        low, high, last = self.codes, self.codes, np.arange(n)
        while True:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
            begin = np.flatnonzero(place % FAN_OUT == 0)
            end = np.r_[begin[1:], len(key)]
            low, high, last, key = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin), last[end - 1], key[begin]
            self.levels.append((low | ~high, low, begin, end, last))
            if len(first) == len(begin):
                break
        top = self.levels[-1]
        self.root = np.searchsorted(top[4], np.arange(n))

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in index order) of pairs of codes under one root that differ in at most so many bits, each pair once."""
        for at in range(0, len(self.codes), QUERIES):
            q = np.arange(at, min(at + QUERIES, len(self.codes)))
            mask, pattern, begin, end, last = self.levels[-1]
            node = self.root[q]
            found = np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node]).astype(np.int64)
            for level in reversed(self.levels[:-1]):
                keep = (found <= most) & (last[node] > q)
                q, node, found = q[keep], node[keep], found[keep]
                n = end[node] - begin[node]
                if not n.sum():
                    q = q[:0]
                    break
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[node], n)
                above = np.repeat(mask[node], n)
                q, found = np.repeat(q, n), np.repeat(found, n)
                mask, pattern, begin, end, last = level
                node = child
                found = found + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node] & ~above)
            else:
                keep = (found <= most) & (node > q)
                yield q[keep], node[keep]


def _parts(width: int, shift: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of so many nearly equal runs of bits."""
    cuts = [round(i * width / parts) for i in range(parts + 1)]
    return [(shift + a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprint_links(codes: DataFrame, most: int = 3) -> DataFrame:
    """(a long, b long): links that connect the distinct fingerprints (fp, rep) which differ in at most most bits.

    The upper nodes factor one of most + 1 masked bit patterns: codes that differ in at most most bits agree
    under at least one mask, so a search that starts only at roots with no difference so far loses none. Each
    root's codes meet in one task, which builds the nodes below and searches them; a root with over
    ROOT_CODES codes is parted by the same rule on its other bits. A task returns a spanning forest of the
    links it finds, never all pairs.
    """
    masks = _parts(BITS, 0, most + 1)

    def run(shift: int, width: int) -> str:
        return f"shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L" if width < BITS else "fp"

    roots = codes.select("fp", "rep", F.expr(f"explode(array({', '.join(f'struct({j} as mask, {run(*m)} as bits)' for j, m in enumerate(masks))}))").alias("r"))
    roots = roots.select("fp", "rep", "r.mask", "r.bits")
    sizes = roots.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sized = roots.join(sizes, ["mask", "bits"])
    cases = []
    for j, (shift, width) in enumerate(masks):  # the other bits, turned into one run of their own
        other = f"(shiftleft(shiftrightunsigned(fp, {shift + width}), {shift}) | (fp & {(1 << shift) - 1}L))" if shift + width < BITS else f"(fp & {(1 << shift) - 1}L)"
        inner = ", ".join(f"struct({i} as part, shiftrightunsigned({other}, {s}) & {(1 << w) - 1}L as rest)" for i, (s, w) in enumerate(_parts(BITS - width, 0, most + 1)))
        cases.append(f"when mask = {j} then array({inner})")
    parted = sized.select("fp", "rep", "mask", "bits", F.expr(f"explode(case when n <= {ROOT_CODES} then array(struct(-1 as part, 0L as rest)) {' '.join(cases)} end)").alias("p"))
    keyed = parted.select(F.xxhash64("mask", "bits", "p.part", "p.rest").alias("key"), "fp", "rep")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, reps in whole_groups(batches, CHUNK):
            if not (keys[1:] == keys[:-1]).any():
                continue
            index = GrayIndex(keys, fps.view(np.uint64))
            found = list(index.pairs(most))
            a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            label = labels(len(keys), a, b)
            rep = reps[index.order]
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Column arrays of at least least rows, where no run of equal values in the first column is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield tuple(c.to_numpy(zero_copy_only=False) for c in t.slice(0, last).columns)
            held, rows = [t.slice(last)], t.num_rows - last
        else:
            held = [t]
    if rows:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield tuple(c.to_numpy(zero_copy_only=False) for c in t.columns)


def simhash_near_dedup(docs: DataFrame, most: int = 3, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id, n_equal): near-duplicate groups of all rows.

    With a similarity, rows link by an exact Jaccard similarity of their word shingles of at least that, which fingerprints
    of a wider radius find candidates for (see shingles), and the result is (id, component_id).

    Fingerprints link at most or fewer differing bits; component_id is the smallest id reachable by links, n_equal the
    rows that share the fingerprint. A null text is empty and has fingerprint zero, which links like any other. A
    null id gets a fingerprint and the component of its group; repeated rows are copies of each other; other
    columns are ignored; an empty table gives no rows.

    Equal fingerprints are one class, so copies are never paired; classes meet under index roots.
    """
    if similarity is not None:
        from tidewell.llm.shingles import shingle_groups

        return shingle_groups(docs, similarity, words_each, id_col, text_col)
    marked = Written(fingerprints(docs, id_col, text_col, words_each), "fingerprints").df
    classes = marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    links = Written(fingerprint_links(classes.select("fp", "rep").where("rep is not null"), most), "links").df
    found = connected_components(links, "a", "b")
    grouped = classes.join(found, classes["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(grouped, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_equal"))
