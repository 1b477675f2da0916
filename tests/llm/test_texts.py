"""Formatting, tokens, packing, mixing, pseudonyms and quality rules."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, mixing, packing, pii, quality, token_counts
from tidewell.llm.queries import vocabulary

ODD = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "É", "ß", "中", "😀", "\x1c", "\x85", "​", "　", "1", "23", "½", "!!", "<|endoftext|>", "\r\n", "İ", "́", "_", "᠎", "\xa0", "Σ", "가", "ſ", "\0"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_token_counts(spark):
    texts = [*odd_texts(3000), "word " * 5000, "x" * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    k = library("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")).collect()}
    want = {i: (len((t or "").encode()), n := len(k.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts)}
    assert got == want
    assert token_counts.token_counts(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_parts_are_encoded_without_numpy(monkeypatch):
    """A part has a few ids, for which an array of numpy costs as much as a third of the encoding."""
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        encoder = packing.PartEncoder(f.read())
    texts = ["", "Plain words, and more.", "été 12 zz\nomega"]
    want = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "np", None)
    assert [encoder.encoded(t) for t in texts] == want and [encoder.encode(t) for t in texts] == want


def test_packing(spark):
    texts = [*odd_texts(300, 2), "one two three. " * 4000, "Word's, OK! " * 50, None, None]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a"), (0, "b")], "doc_id long, text string").selectExpr("*", "1 as length").repartition(3)
    k, rows = library("word_bpe_49k.json"), packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json")).collect()
    want, places, n = Counter(), defaultdict(list), 0
    import zlib

    for i, t in [*enumerate(texts), (None, "a"), (0, "b")]:
        ids = np.array([*k.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        n += len(ids)
        want.update((i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-n // 4096)
    assert packing.best_fit_packing(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_plans_hold_each_piece_once_and_are_best_in_small_cases():
    def best(items, c):
        rooms, low = [], [len(items)]

        def put(i):
            if len(rooms) >= low[0]:
                return
            if i == len(items):
                low[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                    rooms[j] -= items[i]
                    put(i + 1)
                    rooms[j] += items[i]
            rooms.append(c - items[i])
            put(i + 1)
            rooms.pop()

        put(0)
        return low[0]

    rnd, above = random.Random(3), 0
    for _ in range(300):
        c = rnd.randint(3, 30)
        counts = Counter(rnd.randint(1, c) for _ in range(rnd.randint(1, 9)))
        plan, held, seen = packing.pack_plan(dict(counts), c), defaultdict(list), Counter()
        for length, rank, n, sequence, each, offset in plan.rows:
            assert rank == seen[length]
            seen[length] += n
            for x in range(n):
                held[sequence + x // each].append((offset + x % each * length, length))
        assert seen == counts and len(held) == plan.sequences
        for p in held.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= c
        above += plan.sequences - best(sorted(counts.elements(), reverse=True), c)
    assert above <= 3


def test_chat(spark):
    rnd = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\\", "\\p", "\\b", "<", "|", "<|", "\n", "é😀", " ok", "<|im_sep|>", "<\\p", "\\n"]
    rows = [(c, rnd.choice([t, 1, None]), rnd.choice(["user", "assistant", "assistant", "sys\ntem", None, "<|a\\n"]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))])) for c in range(120) for t in range(rnd.randint(1, 7))]
    rows += [(None, 0, "user", "x"), *rows[:3]]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rows"))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), (r or "").encode(), (x or "").encode()))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        loss = b"".join(x for _, r, x in v if r == b"assistant")
        want = len(v), hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in v)).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    for r in chats.collect():  # the mask, followed run by run, covers the same texts
        at, under = 0, ""
        for run in r.loss_runs:
            under += r.formatted[at : at + run.chars] if run.on else ""
            at += run.chars
        assert at == len(r.formatted) == got[r.conv_id].formatted_chars
        assert hashlib.sha256(under.replace("<\\p", "<|").replace("\\b", "\\").encode()).hexdigest() == got[r.conv_id].loss_sha256
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    w, total, fixed = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        t = {k: (total - sum(fixed.values())) * w[k] / max(1, sum(w[j] for j in free)) for k in free}
        over = [k for k in free if t[k] > 3 * sizes[k]]
        if not over:
            return fixed | t
        fixed |= {k: 3 * sizes[k] for k in over}


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randint(0, 60)), rnd.choice(["a", "a", "a", "b", "é", "z", None, "c"])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "empty"), (None, "x y", "a"), rows[0], (702, "big " * 900, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as target")
    got = mixing.mix_sources(docs).select("doc_id", "source", "mix.*").collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == r["size"] * len(r.placements) <= 3 * r["size"] and all(0 <= p.shard < 16 for p in r.placements)
    want = targets(sizes)
    assert len(got) == len(rows)
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[k] - want[k]) <= 30 for k in want)
    again = mixing.mix_sources(docs.repartition(7)).select("doc_id", "source", "mix.*").collect()
    assert Counter((r.doc_id, r.taken, tuple(r.placements)) for r in again) == Counter((r.doc_id, r.taken, tuple(r.placements)) for r in got)
    assert mixing.shuffled(mixing.mix_sources(docs)).count() == sum(len(r.placements) for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_pseudonyms(spark):
    text = 'Card 4111 1111 1111 1111, a@b.co; +1 (017) 555-7713. IP 10.0.0.255, dob 1984-02-29, bad 1984-02-30 ssn 123-45-6789 token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" v 2.0 1.2.3.4.5 no card 4111111111111112'
    rows = [(1, text), (2, None), (3, ""), (4, "plain words"), (5, "4111-1111-1111-1111 A@b.co 1984-02-29"), (None, "4111111111111111")]
    got = {r.id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "id int, text string").selectExpr("*", "1 as found"), "k").collect()}
    assert tuple(got[1].private) == (1, 1, 1, 1, 1, 1, 1) and got[2].text is None and got[3].text == "" and got[4].text == "plain words"
    for gone in ("4111 1111 1111 1111", "a@b.co", "555-7713", "10.0.0.255", "1984-02-29", "123-45-6789", "9233A8EC"):
        assert gone not in got[1].text
    for stays in ("1984-02-30", "v 2.0 1.2.3.4.5", "4111111111111112", "+1 ("):
        assert stays in got[1].text
    one, five = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text)[0], got[5].text.split(" ")
    assert one.replace(" ", "") == five[0].replace("-", "") == got[None].text and five[1] in got[1].text and five[2] in got[1].text
    d = spark.range(0, 10**16, 4 * 10**12).select(F.lpad(F.col("id").cast("string"), 16, "0").alias("d"))
    assert d.where(pii.card("k", pii.card("k", F.col("d")), True) != F.col("d")).count() == 0
    assert d.where(pii.luhn_sum(F.col("d")) % 10 != pii.luhn_sum(pii.card("k", F.col("d"))) % 10).count() == 0
    day = spark.range(0, 146_097, 97).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert day.where(pii.date("k", pii.date("k", F.col("d")), True) != F.col("d")).count() == 0
    assert day.select(pii.date("k", F.col("d")).alias("x")).distinct().count() == day.count()


def test_secrets_without_digits_and_long_ones(spark):
    value, long = "correct-horse-battery", "Ab-" * 400
    texts = [f'password = "{value}"', f'Secret: "{value}" in 2024', f"API-key='{long}'", f'token="{"x" * 512}"', f'token="{"x" * 513}"', f'token="{long}']
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "k").orderBy("id").collect()]
    hidden = [re.search("[\"'](.*)[\"']", t)[1] for t in got[:5]]
    assert hidden[0] == hidden[1] != value and [len(h) for h in hidden] == [21, 21, 1200, 512, 513]
    assert long not in got[2] and "xxx" not in got[3] + got[4] and got[5] == texts[5]


def test_numbers_stay_valid_and_the_key_hidden(spark):
    area = "case when id % 899 >= 665 then id % 899 + 2 else id % 899 + 1 end"
    d = spark.range(20_000).selectExpr(f"concat(lpad(case when {area} > 899 then 1 else {area} end, 3, '0'), lpad(id % 99 + 1, 2, '0'), lpad(id * 7 % 9999 + 1, 4, '0')) as d").where("not d like '666%'").distinct()
    moved = d.select("d", pii.ssn("k", F.col("d")).alias("x"))
    assert moved.where("x like '000%' or x like '666%' or x like '9%' or substr(x, 4, 2) = '00' or substr(x, 6) = '0000' or length(x) <> 9").count() == 0
    assert moved.select("x").distinct().count() == d.count() and moved.where(pii.ssn("k", F.col("x"), True) != F.col("d")).count() == 0
    out = pii.pseudonymise(spark.createDataFrame([(1, "a@b.co")], "id int, text string"), "a-very-secret-key")
    assert "a-very-secret-key" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pii.pseudonymise(out.select("id", "text"), "")


def test_pseudonyms_against_a_scan_by_hand(spark):
    """Whole texts: what simple patterns find is gone, all between finds is as it was, equal values have equal pseudonyms."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    long = "x" * 90 + "@" + ".".join(["sub"] * 12) + ".example.org"
    docs = docs.unionByName(spark.createDataFrame([(-1, f"write to {long}, or to {long.upper()}"), (-2, "word " * 200_000 + "a.b@c.org"), (-3, None)], docs.schema))
    simple = re.compile(r"[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    seen, found = {}, 0
    for i, t in before.items():
        for m in simple.finditer(t or ""):
            if re.match(r"(000|666|9)|\d{3}-00|.*-0000$", m[0]) and "@" not in m[0]:
                continue
            found += 1
            assert m[0] not in after[i]
        marks = [w for w in re.findall(r"[a-zäöüßéèêçñóíá]+", t or "") if len(w) > 3][:50]
        assert all(w in after[i] for w in marks if not simple.search(t))
        for a, b in zip(simple.findall(t or ""), simple.findall(after[i] or "")) if t and len(simple.findall(t)) == len(simple.findall(after[i])) else ():
            if "@" in a:
                assert seen.setdefault(a.lower(), b) == b
    assert found > 5 and after[-3] is None and after[-2].startswith("word " * 200_000) and long not in after[-1]
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(runs), set()
    for i, x in enumerate(runs):
        if n[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 60))) for _ in range(120)] + [" ".join(rnd.choice(["***", "$$", "x#y"]) for _ in range(40)) for _ in range(40)]
    texts += [None, "", " \n\t\x0b", "é中😀 " * 25, "one two three four five six seven eight\n" * 3, "a b c d e f g h " * 2 + "z", "#*$%&|<>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as words", "2 as row")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 160, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    return texts, model, quality.quality_rules(docs, model).collect()


def test_quality_counts(judged):
    texts, model, rows = judged
    for r in rows:
        q, want = r.quality, base(texts[r.doc_id])
        assert tuple(q)[:5] == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert q.base_failed == failed and q.kept == (not failed and q.score >= model.threshold)


def test_quality_verdicts(judged):
    _, _, rows = judged
    good = [r.quality.kept for r in rows if r.doc_id < 120 and not r.quality.base_failed]
    junk = [r.quality.kept for r in rows if 120 <= r.doc_id < 160]
    assert np.mean(good) > 0.95 and not any(junk)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, "u v " + "x y z " * 10)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, quality.fit(docs, none)).count() == 2
    assert quality.quality_rules(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
