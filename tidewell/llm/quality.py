"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_CLASS, Written, let, word_array

#: Characters that count as symbols.
SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(hashes: Column, doublings: int = 3) -> Column:
    """Words in runs of 2 ** doublings words that the text holds more than once, the first included, from its words' hashes.

    A run's 64-bit hash is made of its halves' hashes, so each doubling costs two hashes a word.
    """
    window = 1 << doublings

    def count(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def covered(r: Column) -> Column:
            n = F.size(r)
            again = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (r[j]["k"] == r[F.greatest(j - 1, F.lit(0))]["k"]) & (j > 0) | (r[j]["k"] == r[F.least(j + 1, n - 1)]["k"]) & (j < n - 1))
            places = F.sort_array(F.transform(again, lambda j: r[j]["i"]))
            return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))), F.lit(0), lambda s, x: s + x))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(ranked, covered))

    def doubled(h: Column, half: int) -> Column:
        if half == window:
            return let(h, count)
        runs = let(h, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1 - half), lambda i: F.xxhash64(x[i], x[i + half])))
        return doubled(runs, 2 * half)

    return F.when(F.size(hashes) <= window, 0).otherwise(doubled(hashes, 1)).cast("long")


def base_rules(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    return {
        "n_words": n_words(words),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)),
        "n_symbols": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long"),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(hashes),
    }


def shape(text: Column) -> Column:
    """text with each run of lower-case letters as one a, of other letters as one A, of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Ll}+", "a"), r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]+", "A"), r"\p{N}+", "0")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, shapes: Column, buckets: int) -> Column:
    """Buckets of a text's n-grams: its words, by their hashes, and pairs of neighbouring word shapes, an end counting as a neighbour."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = let(shapes, lambda s: F.transform(s, lambda w, i: F.pmod(F.xxhash64(w, F.when(i + 1 < F.size(s), s[i + 1]).otherwise(F.lit("")), F.lit(2)), F.lit(buckets)).cast("int")))
    return F.concat(one, two)


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, and the score below which a text is rejected."""

    ratio: list[float]
    threshold: float

    def score(self, g: Column) -> Column:
        """Mean log ratio of a text's n-grams; 0 for none."""
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in self.ratio)), ",").cast("array<double>")
        total = F.aggregate(g, F.lit(0.0), lambda s, b: s + table[b])
        return F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0))


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """(id, good) of at most most labelled documents of either class, chosen by a hash of the id."""
    each = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("good"))
    order = [F.xxhash64(F.lit(5), "label_id"), F.col("label_id")]
    return each.where("good = 1").orderBy(*order).limit(most).union(each.where("good = 0").orderBy(*order).limit(most))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, most_labelled: int = 20_000, keep: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a corpus and its labels (doc_id, quality 0 or 1).

    Corpus counts take every document. The trusted multinomial takes the labelled good documents, at most
    most_labelled of them, and so does the threshold, with as many bad ones: it lies where at least keep of the good stay, or
    lower, where the classes part. Without good labels nothing is rejected by score.
    """
    text, words = F.col("__text"), F.col("__words")
    spark = docs.sparkSession
    sample = Written(_sample(labels, most_labelled), "labels").df
    rows = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("__text"))
    marked = rows.join(F.broadcast(sample), F.col("__id") == F.col("label_id"), "left")
    g = grams(word_hashes(words), F.col("__shapes"), buckets)
    split = marked.withColumn("__words", word_array(text)).withColumn("__shapes", word_array(shape(text)))
    counts = split.select("good", F.explode(g).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("good") == 1, 1)).alias("trusted"))
    table = {r["bucket"]: (r["raw"], r["trusted"]) for r in counts.collect()}  # at most buckets rows
    raw, trusted = (sum(v[i] for v in table.values()) for i in (0, 1))
    if not trusted:
        return Model([0.0] * buckets, float("-inf"))
    ratio = [math.log(((n := table.get(b, (0, 0)))[1] + 1) / (trusted + buckets)) - math.log((n[0] + 1) / (raw + buckets)) for b in range(buckets)]
    model = Model(ratio, 0.0)
    known = rows.join(F.broadcast(sample), F.col("__id") == F.col("label_id"))
    scored = known.withColumn("__words", word_array(text)).withColumn("__shapes", word_array(shape(text))).select("good", (F.size(words) < MIN_WORDS).alias("short"), let(g, model.score).alias("score"))
    at = scored.where("not short").agg(F.percentile(F.when(F.col("good") == 1, F.col("score")), F.lit(1 - keep)).alias("low"), F.percentile(F.when(F.col("good") == 0, F.col("score")), F.lit(keep)).alias("bad_high")).first()
    low = at["low"] if at["low"] is not None else float("-inf")
    if at["bad_high"] is not None and at["bad_high"] < low:  # the classes part: stay near the bad
        low = at["bad_high"] + (low - at["bad_high"]) / 4
    return Model(ratio, low)


def quality_rules(docs: DataFrame, model: Model, buckets: int = 1 << 14, text_col: str = "text") -> DataFrame:
    """Every row of docs with struct column quality: the counted rules, base_failed, score and kept.

    A null text has no words and fails; so does one with under 20 words, or with over 30% of its words in repeated 8-word
    runs. The others are kept if their score reaches the model's threshold. Texts are taken whole; a row is judged by itself, so repeated rows get
    equal verdicts and ids may be null. All columns of docs stay, whatever their names but quality. No shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    names = docs.columns
    split = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text")).withColumn("words", word_array(F.col("text")))
    split = split.withColumn("shapes", word_array(shape(F.col("text")))).withColumn("hashes", word_hashes(F.col("words")))
    rules = split.select("row", *(c.alias(k) for k, c in base_rules(F.col("text"), F.col("words"), F.col("hashes")).items()), let(grams(F.col("hashes"), F.col("shapes"), buckets), model.score).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rules = rules.withColumn("base_failed", failed)
    quality = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))).alias("kept"))
    return rules.select("row.*", quality.alias("quality"))
