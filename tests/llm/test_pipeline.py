import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import pytest
from tidewell.llm import queries, simhash

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = spark.createDataFrame(stage(spark, docs, D).toPandas(), docs.schema)
        assert docs.columns == columns and docs.count() > 0
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(left) <= ids and (i > 2 or len(left) == len(set(left)))
        ids = set(left)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, D).collect()
    assert {r.doc_id for r in packed} == ids and sum(r.piece == 0 for r in packed) == docs.count()


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in queries.QUERIES if k.startswith("op")] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        duck.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, D)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_near_dedup_is_by_shingle_similarity(spark):
    rnd = random.Random(3)
    rows = [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  WORDS"), (None, "two words")]
    for i in range(40):
        words = [rnd.choice("abcdefgh") + str(rnd.randrange(400)) for _ in range(rnd.choice([30, 120, 300]))]
        for k in range(5):
            own = list(words)
            for _ in range(rnd.randint(0, len(own) // 40)):
                own[rnd.randrange(len(own))] = f"new{rnd.randrange(99)}"
            rows.append((i * 5 + k, " ".join(own)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets if i is not None}
    pairs = [(a, b) for a, b in combinations(group, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, D).collect()]
    assert sorted(got) == sorted({g for g in group.values()})  # the row without an id is a copy of one with
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"), (7, "k l m n o p"), (7, "k l m n o p"), (7, "other words stand in this row")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, odd, D).collect()]
    assert sorted(left, key=str) == [(7, "k l m n o p"), (None, "a b c d e f"), (None, "x y z u v w")]
    far = [p for p in pairs if sets[p[0]] != sets[p[1]] and (simhash.fingerprint(dict(rows)[p[0]]) ^ simhash.fingerprint(dict(rows)[p[1]])).bit_count() > 3]
    assert len(pairs) > 50 and len(far) > 20
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), D).count() == 0


def test_line_stage_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "this line is long enough", "en", "a", 24), (2, "This line is long enough!", "en", "b", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, D)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, "this line is long enough", 24), (2, "", 0)]
    assert not any(hasattr(corpus_pipeline.lines, x) for x in ("mark_lines", "alike_pairs"))
