"""Spelling variants by wildcard groups, without pairs of words.

Words that differ by one replaced character stand in one group once that character is
left open, and in one only. A group keeps its size and its two foremost words; each member
takes the foremost word that is not itself. A group holds at most one word for each
character of the alphabet. Words that differ by one inserted character meet where the
longer one, with a character deleted, is joined to the vocabulary. All is summed by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
SLIP = 97

_RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    # For ASCII text lower() does the same and is faster.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _without(word: Column, at: Column, hole: str = "") -> Column:
    """``word`` with ``hole`` for its character ``at``, counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(hole), F.substring(word, at + 1, F.length(word)))


def runs(docs: DataFrame, text: str = "text", slip: int | None = SLIP) -> DataFrame:
    """``word``: every run of letters, lower-cased; with ``slip`` runs whose crc32 with their document it divides lose a character."""
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    found = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(_lower(docs[text]), F.lit(_RUN), 0)).alias("word"))
    if slip is None:
        return found.select("word")
    h = F.crc32(F.concat("doc", F.lit(":"), "word"))
    hit = found.withColumn("h", h)
    return hit.select(F.when(F.col("h") % slip == 0, _without(F.col("word"), (F.col("h") % F.length("word")).cast("int") + 1)).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of words long and frequent enough; counted before they are dealt by word."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _rank(n: str | Column, word: str | Column) -> Column:
    """Orders candidates: largest count first, then code points."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("n"), (F.col(word) if isinstance(word, str) else word).alias("word"))


def near(vocab: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n_near, best`` for words of ``vocab`` (``word, n``) that have near words; ``best`` is a struct of ``n``, negative, and ``word``."""
    places = F.sequence(F.lit(1), F.length("word"))
    holes = vocab.select("word", _rank("n", "word").alias("me"), F.explode(F.transform(places, lambda p: _without(F.col("word"), p, "*"))).alias("key"))
    group = Window.partitionBy("key")
    foremost = group.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = holes.select("word", "me", F.count(F.lit(1)).over(foremost).alias("size"), F.first("me").over(foremost).alias("one"), F.nth_value("me", 2).over(foremost).alias("two"))
    replaced = top.where("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("one") == F.col("me"), F.col("two")).otherwise(F.col("one")).alias("best"))

    shorter = F.array_distinct(F.transform(places, lambda p: _without(F.col("word"), p)))
    cut = vocab.where(F.length("word") > min_length).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(shorter).alias("word"))
    met = cut.join(maybe_broadcast(vocab, 100), "word")
    both = F.array(F.struct(F.col("word"), _rank("long_n", "long").alias("best")), F.struct(F.col("long").alias("word"), _rank("n", "word").alias("best")))
    indels = met.select(F.explode(both).alias("s")).select("s.word", F.lit(1).cast("long").alias("n_near"), "s.best")
    return replaced.unionByName(indels).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms`` (``word, form``): the last of the forms that follow one another.

    Every round doubles the steps taken. Forms never come back to a word, as counts grow.
    """
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = maybe_broadcast(now.select(F.col("word").alias("root"), F.col("root").alias("next")), 100)
        moved = durable(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        now = moved.drop("moved")


def variants(vocab: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``vocab`` (``word, n``).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is
    the near word of largest count (ties: smallest by code points) if it counts at least
    ``ratio`` (over 1) times the word's own, else null. Words must have at least ``min_length``
    code points and stand once in ``vocab``; an empty one gives an empty result.
    """
    vocab = durable(vocab)
    judged = vocab.join(near(vocab, min_length), "word", "left").withColumn("form_n", -F.col("best.n"))
    formed = F.col("form_n") >= ratio * F.col("n")
    judged = durable(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return judged.join(maybe_broadcast(ends, 100), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, text: str = "text", slip: int | None = None) -> DataFrame:
    """``variants`` of all words of ``docs``.

    Defined cases: null and empty texts have no words, texts of any length are read whole,
    repeated rows count again, an empty table gives an empty result, a null ``doc_id`` is spelled as the
    empty text where slips are planted, and other columns are not read.
    """
    return variants(vocabulary(runs(docs, text, slip)))
