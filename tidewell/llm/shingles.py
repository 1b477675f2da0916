"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints under a Gray-order index find pairs, exact similarity decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Written, release, sent_if_small
from tidewell.llm.components import connected_components
from tidewell.llm.simhash import CHUNK, GrayIndex, whole_groups

SEED = 42
#: Fingerprints of a set, each of other hashes; bits in which those of two similar sets may differ in one of them, and in all together.
PRINTS, MOST, MOST_OF_ALL = 3, 16, 44
#: A root is a pair of the eight bytes of a fingerprint: six or fewer differing bits leave two bytes whole.
BYTES = list(combinations(range(8), 2))
#: Codes of a root that meet in one task at most; a larger root is parted into pairs of halves of that.
ROOT = 4096
#: Odd multipliers that make further hashes of a shingle's.
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text with fewer words is one shingle, without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint
    k = min(words_each, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1 if k else 0)], np.uint64))


def prints(shingles: np.ndarray) -> list[int]:
    """The PRINTS SimHashes of a set of shingles, as signed longs; none for an empty set."""
    if not len(shingles):
        return []
    out = []
    for m in _MIX:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            h = shingles[at : at + (1 << 16)] * m
            h ^= h >> np.uint64(32)
            ones += np.unpackbits((h * m).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True))
    return out


def shingled(rows: DataFrame, words_each: int, whole: bool) -> DataFrame:
    """(id, key, prints) of rows (id, t), or (key, shingles) if whole; rows with equal shingles share the key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sets = [shingle_set(t, words_each) for t in b.column(1).to_pylist()]
                key = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                if whole:
                    yield pa.RecordBatch.from_arrays([key, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "shingles"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), key, pa.array([prints(s) for s in sets], pa.list_(pa.int64()))], names=["id", "key", "prints"])

    return rows.mapInArrow(of, "key long, shingles array<long>" if whole else "id long, key long, prints array<long>")


def near_prints(sets: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """(a long, b long, root long): pairs of sets (key, comp, prints) whose fingerprints are near under a common root.

    A root is a masked bit pattern of one fingerprint; its codes meet in one task, in Gray order under nodes that hold the
    bits they share. A root with more than two near pairs a code returns each code's smallest partner alone and is named in
    a row without a pair. With such roots given as dense, they alone are searched, and return every near pair of different
    components.
    """
    mask = [sum(0xFF << (8 * i) for i in pair) for pair in BYTES]
    signed = [m - (1 << 64) if m >> 63 else m for m in mask]
    kinds = [F.struct(F.lit(p).cast("byte").alias("print"), F.xxhash64(F.lit(p), F.lit(j), F.col("prints")[p].bitwiseAND(F.lit(m).cast("long"))).alias("root")) for p in range(PRINTS) for j, m in enumerate(signed)]
    codes = [F.col("prints")[p].alias(f"code{p}") for p in range(PRINTS)]
    roots = sets.where(F.size("prints") > 0).select("key", "comp", *codes, F.explode(F.array(*kinds)).alias("r")).select("r.root", "r.print", "key", "comp", *(f"code{p}" for p in range(PRINTS)))
    if dense is not None:  # a search for what the first left
        roots = roots.join(sent_if_small(dense), "root", "left_semi")
    large = roots.groupBy("root").agg(F.count("*").alias("n")).where(f"n > {ROOT}")
    sized = roots.join(sent_if_small(large), "root", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / (ROOT // 2)), F.lit(1)).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = met.select(F.when(F.col("parts") > 1, F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("root")).alias("at"), "root", "print", "key", "comp", *(f"code{p}" for p in range(PRINTS)))

    again = dense is not None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, root, kind, key, comp, *code in whole_groups(batches, CHUNK):
            if not (at[1:] == at[:-1]).any():
                continue
            every = np.stack(code).view(np.uint64)
            index = GrayIndex(at, every[kind, np.arange(len(at))])
            place, root, key, comp, every = at[index.order], root[index.order], key[index.order], comp[index.order], every[:, index.order]
            found = []
            for a, b in index.pairs(MOST):
                near = (comp[a] != comp[b]) & (np.bitwise_count(every[:, a] ^ every[:, b]).sum(axis=0) <= MOST_OF_ALL)
                a, b = a[near], b[near]
                if not again and len(a):  # at most two pairs a code, or each code's smallest partner
                    low, high = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
                    order = np.lexsort((low, high, place[a]))
                    a, b = a[order], b[order]
                    low, high = low[order], high[order]
                    groups, at_, n = np.unique(place[a], return_inverse=True, return_counts=True)
                    full = n > 2 * (np.searchsorted(place, groups, "right") - np.searchsorted(place, groups))
                    one = np.r_[True, (high[1:] != high[:-1]) | (at_[1:] != at_[:-1])] | ~full[at_]
                    named = np.unique(root[np.searchsorted(place, groups[full])])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(named), pa.int64()), pa.nulls(len(named), pa.int64()), pa.array(named)], names=["a", "b", "root"])
                    a, b = a[one], b[one]
                found.append((key[a], key[b]))
            if found:
                x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.nulls(len(x), pa.int64())], names=["a", "b", "root"])

    return keyed.repartition("at").sortWithinPartitions("at").mapInArrow(search, "a long, b long, root long").distinct()


def similar_links(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a long, b long): verified links that connect the sets (key, prints) which are similar and share a root of the index.

    Near pairs under each root are verified, in roots with many of them each code's with its smallest partner first; what
    that connects is one component, and then every near pair of different components in those roots is verified.
    whole(keys) gives (key, shingles) of the sets that are asked for.
    """

    def verified(pairs: DataFrame) -> Written:
        known = Written(whole(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()), "shingles")
        sides = [known.df.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b")]
        both = F.size(F.array_intersect("sa", "sb"))
        found = Written(pairs.join(sides[0], "a").join(sides[1], "b").where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - F.lit(1e-9)).select("a", "b"), "links")
        known.drop()
        release(sets.sparkSession)
        return found

    met = Written(near_prints(sets.select("key", F.col("key").alias("comp"), "prints")), "pairs")
    release(sets.sparkSession)
    first = verified(met.df.where("root is null").select("a", "b"))
    comps = Written(connected_components(first.df, "a", "b"), "components")
    rows = sets.join(comps.df, sets["key"] == comps.df["node"], "left").select("key", F.coalesce("component", "key").alias("comp"), "prints")
    rest = Written(near_prints(rows, met.df.where("root is not null").select("root").distinct()), "pairs")
    second = verified(rest.df.select("a", "b"))
    links = Written(first.df.union(second.df), "links")
    for done in (met, first, comps, rest, second):
        done.drop()
    release(sets.sparkSession)
    return links.df


def shingle_groups(docs: DataFrame, similarity: float = 0.8, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of all rows: groups of what a Jaccard similarity of word shingles of at least similarity connects.

    component_id is the smallest id of the group, null if it has none. Equal texts are one class, so copies are never
    paired; texts without words are equal. Repeated rows are copies of each other; other columns are ignored. An empty
    table gives no rows. Shingles are kept of rows with a near partner alone, and made anew from their texts.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    marked = Written(shingled(rows, words_each, False), "prints").df
    sets = Written(marked.groupBy("key").agg(F.first("prints").alias("prints"), F.min("id").alias("rep")), "sets").df

    def whole(keys: DataFrame) -> DataFrame:
        wanted = Written(sets.join(keys, "key").select("rep").distinct(), "wanted").df
        found = shingled(rows.join(sent_if_small(wanted, 1_000_000), F.col("id").eqNullSafe(F.col("rep")), "left_semi"), words_each, True)
        return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))

    links = similar_links(sets.select("key", "prints"), whole, similarity)
    found = connected_components(links, "a", "b")
    grouped = Written(marked.select("id", "key").join(found, marked["key"] == found["node"], "left").select("id", F.coalesce("component", "key").alias("component")), "grouped").df
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    return grouped.join(least, "component").select(F.col("id").alias(id_col), "component_id")
