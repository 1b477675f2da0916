"""Line, embedding, substring and SimHash dedup against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import embeddings, lines, simhash, substrings
from tidewell.llm.components import connected_components

WORDS = "alpha beta gamma delta été ñu omega 12 zz, ( x".split()


def roots(items, links):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 30, 60, 150]))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = " ".join(rnd.choice(base) for _ in range(rnd.randint(0, 3))).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((i * 3, rnd.choice([" ", "\n", "  "]).join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a\0b \0\n c " + "y " * 40), (-5, rows[5][1]), (1004, rows[5][1]), (1005, "Äß ı İ " * 9)]


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "a", "b").collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_substrings(rows):
    words, first = {i: (t or "").encode().split() for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("words_each", [1_500_000, 300])
def test_substrings(spark, monkeypatch, words_each):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", words_each)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as kept").repartition(3)
    assert {r[0]: tuple(r)[1:] for r in substrings.substring_dedup(docs).collect()} == brute_substrings(rows)


def test_substrings_odd_rows(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (None, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.substring_dedup(docs).collect()) == [(-1, 0), (-1, 13), (1, 0), (1, 0)]
    assert substrings.substring_dedup(docs.limit(0)).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROOT_CODES", 3)  # parts large roots here too
    rows = corpus(2)
    prints = {i: brute_print(t) for i, t in rows}
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash.simhash_near_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as id"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {i: (format(prints[i], "016x"), want[i]) for i in prints}
    assert simhash.simhash_near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 5])
def test_gray_index(most):
    rng = np.random.default_rng(most)
    codes = [int(b) for b in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    codes += [c ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 7)).tolist())) for c in codes * 8]
    codes = np.unique(np.array(codes, np.uint64))
    keys = np.arange(len(codes)) % 3
    index = simhash.GrayIndex(keys, codes)
    k, c = keys[index.order], codes[index.order]
    want = {(i, j) for i, j in combinations(range(len(c)), 2) if k[i] == k[j] and int(c[i] ^ c[j]).bit_count() <= most}
    assert {p for a, b in index.pairs(most) for p in zip(a.tolist(), b.tolist())} == want


@pytest.mark.parametrize("cell", [2048, 20])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rng, rows = np.random.default_rng(0), []
    for b in rng.standard_normal((60, 32)):
        b /= np.linalg.norm(b)
        for _ in range(4):
            o = rng.standard_normal(32)
            o -= o @ b * b
            c = rng.uniform(0.955, 0.99)
            rows.append((len(rows) * 3, (c * b + np.sqrt(1 - c * c) * o / np.linalg.norm(o)).tolist()))
        rows.append((len(rows) * 3, b.tolist()))
    rows += [(1, rows[0][1]), (2, rows[0][1]), (4, [3 * x for x in rows[0][1]])]
    odd = [(5, None), (7, [0.0] * 32), (8, [float("nan")] * 32), (10, [None] + [1.0] * 31), (11, []), (13, [float("inf")] * 32)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    got = {r.vec_id: r for r in embeddings.embedding_near_dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep")).collect()}
    links = dict(zip(ids, near.sum(axis=1) - 1))
    assert sum(got[i].n_links for i in ids) >= 0.98 * sum(links.values()) and all(got[i].n_links <= links[i] for i in ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in got) and np.mean([got[i].component_id == want[i] for i in ids]) > 0.97
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _ in odd)


def brute_lines(rows, similarity=0.8):
    """Texts without repeated lines, by the edit distance of every two normalised lines: no fingerprint, block or bound.

    Also the number of lines that go as alike ones, and of those that go as equal ones.
    """
    import duckdb
    import pyarrow as pa

    def norm(x):
        return regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")

    first, places = {}, 0
    for i, t in rows:
        for k, x in enumerate(t.split("\n") if t is not None else ()):
            if len(norm(x)) >= 10:
                places += 1
                first[norm(x)] = min(first.get(norm(x), (i, k)), (i, k))
    names = sorted(first, key=len)
    size = np.array([len(x) for x in names])
    # a character for each that occurs, so that the distance counts characters; pairs apart by length or letters are left out
    seen = {c: chr(33 + i) for i, c in enumerate(sorted({c for x in names for c in x}))}
    assert len(seen) < 94
    plain = ["".join(seen[c] for c in x) for x in names]
    counts = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=128) for x in plain], np.int32)
    pairs = []
    for i in range(len(names)):
        j = np.arange(i + 1, np.searchsorted(size, int(size[i] / similarity) + 1, "right"))
        most = np.floor(size[j] * (1 - similarity) + 1e-9)
        pairs += [(i, int(x)) for x in j[np.maximum((counts[j] - counts[i]).clip(0).sum(1), (counts[i] - counts[j]).clip(0).sum(1)) <= most]]
    t = pa.table({"i": [p[0] for p in pairs], "j": [p[1] for p in pairs], "a": [plain[p[0]] for p in pairs], "b": [plain[p[1]] for p in pairs]})  # noqa: F841
    links = duckdb.sql(f"select i, j from t where levenshtein(a, b) <= floor(greatest(length(a), length(b)) * {1 - similarity:.9f} + 1e-9)").fetchall() if pairs else []
    group, least = roots(range(len(names)), links), {}
    for a, r in group.items():
        least[r] = min(least.get(r, first[names[a]]), first[names[a]])
    stay = set(least.values())
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(norm(x)) < 10 or (i, k) in stay) for i, t in rows}, len(names) - len(least), places - len(names)


@pytest.mark.parametrize("meet", [256, 6])
def test_lines(spark, monkeypatch, meet):
    monkeypatch.setattr(lines, "MEET", meet)
    rnd, rows = random.Random(5), []
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(rnd.choice([4, 12, 60]))) for _ in range(15)]
    for i in range(120):
        own = []
        for _ in range(rnd.randint(0, 5)):
            w = rnd.choice(base).split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2]) if len(w) > 4 else 0):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            own.append(rnd.choice([" ".join(w), " ".join(w).upper() + "!!", "", "x.y"]))
        rows.append((i, "\n".join(own) if i % 17 else None))
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stay", "2 as id"))
    want, due, equal = brute_lines(rows)
    gone = sum(r.lines.n_removed for r in got.collect()) - equal
    # blocks find alike lines by chance: nothing that is not due goes, and nine tenths at least of what is
    assert due > 20 and 0.9 * due <= gone <= due and got.columns == ["doc_id", "text", "stay", "id", "lines"]
    assert sum(r.text != want[r.doc_id] for r in got.collect()) <= due - gone
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want, due, equal = brute_lines(rows)
    got = lines.line_dedup(docs).collect()
    gone = sum(r.lines.n_removed for r in got) - equal
    assert due > 30 and 0.9 * due <= gone <= due
    assert sum(r.text != want[r.doc_id] for r in got) <= due - gone


def test_odd_lines(spark):
    long = " ".join(f"w{k * k % 997}" for k in range(60_000))
    rows = [(None, "this line is long enough\nshort"), (-(1 << 62), "This line is LONG enough!"), (3, "short\nother words are in this line\n" + long), (3, "short\nother words are in this line\n" + long), (4, long + " more"), (5, ""), (6, None)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted(((r.doc_id, r.text, r.lines.n_removed) for r in got.collect()), key=str)
    # a null id comes first, also before the smallest ids; rows with one id are one document
    assert left == sorted([(None, "this line is long enough\nshort", 0), (-(1 << 62), "", 1), (3, rows[2][1], 0), (3, rows[2][1], 0), (4, "", 1), (5, "", 0), (6, None, 0)], key=str)
    with pytest.raises(ValueError):
        lines.line_dedup(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, Lines int"))


def test_edit_bounds(spark):
    rnd, rows = random.Random(2), []
    for k in range(120):
        a = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.choice([5, 40, 700]))]
        b = list(a)
        for _ in range(rnd.choice([0, 1, 3, len(a) // 4])):
            b[rnd.randrange(len(b))] = rnd.choice("ijk")
        if k % 5 == 0:
            b = b[len(b) // 3 :] + b[: len(b) // 3]
        rows.append((" ".join(a), " ".join(b)))
    rows += [("", ""), ("", "abc"), ("a", "b"), ("x" * 2500, "y" * 2500), ("é" * 3000 + "a" * 500, "a" * 500 + "é" * 3000)]
    got = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "levenshtein(a, b) as d").collect()
    assert [lines.edit_distance(r.a, r.b) for r in got] == [r.d for r in got]
    for r in got:
        fifth = max(len(r.a), len(r.b)) // 5
        assert [lines.edits_within(r.a, r.b, m) for m in (fifth, r.d, r.d - 1)] == [r.d <= fifth, True, False]
    assert len({r.d <= max(len(r.a), len(r.b)) // 5 for r in got}) == 2


def test_line_marks():
    """Marks against their definition, a line at a time."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(WORDS[:4]) + str(rnd.randrange(60)) for _ in range(k)) for k in (1, 2, 7, 8, 9, 11, 12, 40, 400)] + ["a a a a a a a a a", "aaaaaaaaaaaa", "漢字仮名交じり文を十文字以上"]
    sims, blocks = lines._marked(texts)
    ones = sum(1 << (4 * k) for k in range(14))

    def marks(keys, least):
        keys = sorted(set(keys))
        bits = [int(x) for x in lines._mixed(np.array(keys, np.uint64) + np.uint64(1))]
        sim = sum(1 << (14 * lane + s) for lane in range(4) for s in range(14) if 2 * sum(b >> (16 * lane + s) & 1 for b in bits) > len(bits))
        k = max(least, int(np.floor(np.log2(len(keys) * 0.4))))
        starts = [i for i, x in enumerate(keys) if not i or x >> (40 - k) != keys[i - 1] >> (40 - k)]
        own = [[bits[(i + j) % len(keys)] for j in range(5)] for i in starts]
        return sim, [sum(b & ones for b in five) ^ sum(b >> 1 & ones for b in five) << 3 for five in own]

    def word_key(w):
        numbers = [int(lines.BYTE_AT[(i % 256) * 256 + x]) for i, x in enumerate(w.encode())]
        return int(lines._mixed(np.array([sum(numbers) % 2**64], np.uint64))[0]) >> 24

    for i, text in enumerate(texts):
        words, want, sim = text.split(" "), [], []
        if len(words) >= lines.LEAST_WORDS:
            s, b = marks([word_key(w) for w in words], lines.WORD_RANGES)
            sim, want = [s], b
        assert [x for x in [sims[0][i].as_py()] if x is not None] == sim
        if len(words) <= lines.MOST_WORDS:
            c = [ord(x) for x in text] + [0, 0]
            code = np.array([c[j] | c[j + 1] << 21 | (c[j + 2] << 42 if c[j + 1] else 0) for j in range(len(text))], np.uint64)
            s, b = marks([int(x) >> 24 for x in lines._mixed(code)], lines.GRAM_RANGES)
            assert sims[1][i].as_py() == s
            want = want + b
        else:
            assert sims[1][i].as_py() is None
        assert blocks[i].as_py() == want


def test_line_expressions(spark):
    """Marks and the edit bound as expressions, against their definitions."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(90)) for _ in range(k)) for k in (1, 2, 8, 40, 130, 700)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "split(t, ' ') as w")
    f = lines.word_features(d.w)
    got = d.select("w", f.alias("f"), lines.simhash(f).alias("s"), lines.blocks(f, lines.WORD_RANGES).alias("b")).collect()
    ones = sum(1 << (4 * k) for k in range(14))
    for r in got:
        keys = sorted({xxhash.xxh64_intdigest(w, 42) - (1 << 64 if xxhash.xxh64_intdigest(w, 42) >> 63 else 0) for w in r.w})
        assert r.f == keys
        assert r.s == sum(1 << i for i in range(56) if 2 * sum(h >> i & 1 for h in keys) > len(keys))
        k = max(lines.WORD_RANGES, int(np.floor(np.log2(len(keys) * 0.4))))
        twice = keys + keys[:4]
        at = [i for i, x in enumerate(keys) if not i or x >> (64 - k) != keys[i - 1] >> (64 - k)]
        assert r.b == [sum(h & ones for h in twice[i : i + 5]) ^ sum(h >> 1 & ones for h in twice[i : i + 5]) << 3 for i in at]
    pairs = [(a, a[: len(a) // 2] + rnd.choice(["", "x y z ", "q" * 30]) + a[len(a) // 2 + rnd.randrange(40) :]) for a in texts] + [("", "abc"), ("x" * 2500, "y" * 2500)]
    p = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "levenshtein(a, b) as d").where("d > 0")
    near = p.select(lines.alike(p.a, p.b, p.d).alias("within"), lines.alike(p.a, p.b, p.d - 1).alias("beyond")).collect()
    assert len(near) > 3 and all(r.within and not r.beyond for r in near)


def test_pairs_of_unlike_length_go_first(spark, monkeypatch):
    """No pair that lengths allow is lost to the lengths in nodes; pairs met before are taken out in one join."""
    pairs = [(a, a - d) for a in [*range(10, 400, 3), 1000, 5000, 10**6] for d in {0, 1, a // 5 - 1, a // 5} if 0 <= d < a]
    pairs += [(100, 70), (1000, 700), (10**6, 7 * 10**5)]
    d = spark.createDataFrame(pairs, "x int, y int")
    nodes = [lines.node_of(F.xxhash64(c), F.xxhash64(F.lit(1), c), d[c]) for c in ("x", "y")]
    may = [r[0] for r in d.select(lines.lengths_may(*nodes, 0.8)).collect()]
    assert all(may[:-3]) and not any(may[-3:])

    plans, written = {}, lines.Written

    class Kept(written):
        def __init__(self, df, label):
            plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString())
            super().__init__(df, label)

    monkeypatch.setattr(lines, "Written", Kept)
    text = "several words that stand in a line of some length for a test of pairs"
    rows = [(1, text), (2, text + " x"), (3, f"{text} y"), (4, "nothing like the others at all here")]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r.lines.n_removed for r in got.collect()) == 2
    assert [p.count("LeftAnti") for p in plans["pairs"]] == [1] and len(plans["twos"]) == 2


def test_lines_run_no_python_and_few_pairs(spark, monkeypatch):
    """Lines that share a passage and are not alike: each pair is compared once at most, by expressions alone."""
    rnd, compared = random.Random(4), []
    passage = " ".join(f"common{k}" for k in range(30))
    rows = [(i, f"{' '.join(str(rnd.randrange(10**6)) for _ in range(12))} {passage} {' '.join(str(rnd.randrange(10**6)) for _ in range(12))}") for i in range(60)]
    rows += [(100 + i, f"{passage} {i}") for i in range(40)]
    written = lines.Written

    class Kept(written):
        def __init__(self, df, label):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))
            super().__init__(df, label)
            if label in ("star", "pairs"):
                compared.extend(tuple(sorted((r.a, r.b))) for r in self.df.collect())

    monkeypatch.setattr(lines, "Written", Kept)
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))
    want, due, _ = brute_lines(rows)
    assert due > 30 and {r.doc_id: r.text for r in got.collect()} == want
    assert len(compared) == len(set(compared)) < 100 * 99 / 2


def test_buckets_part_at_gaps_of_length(spark, monkeypatch):
    """Parting loses no pair that lengths allow; what is alone goes, larger buckets stay whole."""
    rnd = random.Random(6)
    rows = [(b, c, f"{b} {k}") for b in range(60) for k, c in enumerate(int(10 * 1.3 ** rnd.uniform(0, 25)) for _ in range(rnd.randint(3, 9)))]
    rows += [(99, int(10 * 1.5**k), f"99 {k}") for k in range(12)]
    monkeypatch.setattr(lines, "MEET", 10)
    d = spark.createDataFrame(rows, "bucket long, chars int, t string")
    d = d.select("bucket", "chars", lines.node_of(F.xxhash64("t"), F.xxhash64(F.lit(1), "t"), F.col("chars")).alias("node"))
    sums = d.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("c"), F.bit_xor("node").alias("x"))
    parts = {}
    for r in lines.by_length(d.join(sums, "bucket"), 0.8).collect():
        parts.setdefault(r.bucket, []).append(r)
    for part in parts.values():
        nodes = [r.node for r in part]
        assert all((r.n, r.c, r.x) == (len(nodes), min(nodes), int(np.bitwise_xor.reduce(nodes))) for r in part) and len(nodes) > 1
    of = {}
    for r in d.collect():
        of.setdefault(r.bucket, []).append(r)
    due = {tuple(sorted((a.node, b.node))) for x in of.values() for a, b in combinations(x, 2) if min(a.chars, b.chars) >= 0.8 * max(a.chars, b.chars)}
    whole = {tuple(sorted((a.node, b.node))) for a, b in combinations(of[99], 2)}
    met = {tuple(sorted((a.node, b.node))) for x in parts.values() for a, b in combinations(x, 2)}
    assert due | whole <= met and len(parts[99]) == 12
    assert len(met) < sum(len(x) * (len(x) - 1) / 2 for x in of.values()) / 2


def test_texts_move_once_by_pair(spark, monkeypatch):
    """Each text of a pair is dealt once, by its pair; texts that no pair names are not moved."""
    plans, written = [], lines.Written

    class Kept(written):
        def __init__(self, df, label):
            if label == "links":
                plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            super().__init__(df, label)

    monkeypatch.setattr(lines, "Written", Kept)
    text = "several words that stand in a line of some length for a test of pairs"
    rows = [(i, f"{text} {'x' * i}") for i in range(4)] + [(9, "nothing like the others at all here")]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r.lines.n_removed for r in got.collect()) == 3
    assert len(plans) > 3 and all(p.count("RepartitionByExpression [a#") == 2 and "Repartition " not in p and p.count("strategy=broadcast") == 2 for p in plans[:-1])


def test_line_marks_without_inner_loops(spark):
    """Blocks add their hashes without a loop for each; words are aligned only where most have a place, and alike answers as ever."""
    d = spark.createDataFrame([("a b c d e f g h", "s t u v w x y z"), ("a b c d e f g h", "a b c d e f g x")], "a string, b string")
    plan = d.select(lines.blocks(lines.word_features(F.split("a", " ")), lines.WORD_RANGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
    got = d.select(lines.aligned_edits(d.a, d.b).alias("bound"), lines.alike(d.a, d.b, F.lit(8)).alias("far"), lines.alike(d.a, d.b, F.lit(7)).alias("near")).collect()
    assert [tuple(r) for r in got] == [(None, True, False), (1, True, True)]
