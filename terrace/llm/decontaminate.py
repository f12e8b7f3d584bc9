"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``SPAN`` consecutive words the hashes of all ``K``-word grams are taken, and of
each run of ``SPAN - K + 1`` grams the one of smallest hash is kept as a fingerprint.
Two texts that share ``SPAN`` words share such a run and so keep the same gram of it.
Fingerprints of documents and benchmark are joined, and each hit is extended to all
windows of the document around it, whose words are then compared whole. Items shorter than a window are windows as
they are; for each such length that occurs all grams of that length are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast

SPAN = 10
K = 5
#: Benchmarks whose spelled windows take up to so many bytes are broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A fingerprint's low bits are its place, the others its hash. A string holds under 2^31
# bytes and a word takes two with its separator, so every place is below 2^30. What meets
# by the remaining bits of the hash alone goes when windows are compared whole.
_PLACE_BITS = 30
_PLACE = (1 << _PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """Words: A-Z lower-cased, then runs of ASCII letters and digits and of all non-ASCII characters; null has none."""
    text = F.coalesce(text, F.lit(""))
    # For ASCII text lower() does the same and is faster.
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BREAK), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once: inside the lambdas of ``body`` an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """Hash and place of every k-word gram, in one long each; empty for fewer words."""

    def every(words: Column) -> Column:
        def gram(i: Column) -> Column:
            mixed = F.xxhash64(*(F.get(words, i + j) for j in range(k)))
            return mixed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i)

        last = F.size(words) - k
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.when(last >= 0, F.transform(starts, gram)).otherwise(F.array().cast("array<bigint>"))

    return _let(words, every)


def winnow(words: Column, span: int = SPAN, k: int = K) -> Column:
    """Fingerprints of a word array: in each run of ``span - k + 1`` grams the leftmost of smallest hash."""
    run = span - k + 1

    def smallest(grams: Column) -> Column:
        last = F.size(grams) - run
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        picked = F.transform(starts, lambda i: F.least(*(F.get(grams, i + j) for j in range(run))) if run > 1 else F.get(grams, i))
        return F.when(last >= 0, F.array_distinct(picked)).otherwise(F.array().cast("array<bigint>"))

    return _let(_grams(words, k), smallest)


def _exploded(table: DataFrame, prints: str) -> DataFrame:
    """A row for each fingerprint: its hash and place instead of the array."""
    rest = [c for c in table.columns if c != prints]
    # The outer form: for the inner one Spark would evaluate the fingerprints twice, to filter empty arrays.
    rows = table.select(*rest, F.explode_outer(prints).alias("_print"))
    return rows.select(*rest, F.shiftright("_print", _PLACE_BITS).alias("print"), F.col("_print").bitwiseAND(F.lit(_PLACE)).cast("int").alias("place"))


def _spelled(words: str, start: Column, width: int) -> Column:
    """A window as text; words hold no spaces, so equal texts are equal windows."""
    return F.array_join(F.slice(words, start + 1, width), " ")


def _windows(items: DataFrame, size: int, span: int) -> DataFrame:
    """``(window, item_id)`` of the items of this size, each once; size 0: of ``span`` words and more."""
    width = size or span
    wanted = items.where((F.col("n") == size) if size else (F.col("n") >= span))
    starts = wanted.select("item_id", "item_words", F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("start"))
    return starts.select(_spelled("item_words", F.col("start"), width).alias("window"), "item_id").distinct()


def _occurrences(docs: DataFrame, items: DataFrame, windows: DataFrame, size: int, small: bool, span: int, k: int) -> DataFrame:
    """Places where a benchmark window stands: ``(key, start, size, window)``."""
    width = size or span

    def prints(words: str) -> Column:
        return _grams(F.col(words), size) if size else winnow(F.col(words), span, k)

    wanted = items.where((F.col("n") == size) if size else (F.col("n") >= span))
    marks = durable(_exploded(wanted.select(prints("item_words").alias("_p")), "_p").select("print").distinct())
    spelled = windows.select("window").distinct()
    marked = docs.withColumn("_p", prints("words"))
    if small:
        found = _exploded(marked, "_p").join(F.broadcast(marks), "print", "left_semi")
    else:
        # Places first, in narrow rows; words are fetched for the documents that met.
        met = _exploded(marked.select("key", "_p"), "_p").join(marks, "print", "left_semi").select("key", "place").distinct()
        found = met.join(docs.dropDuplicates(["key"]), "key")
    # A hit extends to all windows of the document that hold the gram.
    first = F.greatest(F.col("place") + (size or k) - width, F.lit(0))
    last = F.least(F.col("place"), F.size("words") - width)
    starts = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    near = found.select("key", "words", F.explode_outer(starts).alias("start")).where("start is not null")
    around = near.select("key", "start", F.lit(width).alias("size"), _spelled("words", F.col("start"), width).alias("window"))
    return around.join(F.broadcast(spelled) if small else spelled, "window", "left_semi").select("key", "start", "size", "window").distinct()


def _key(text: str) -> Column:
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("key")


def _found(docs: DataFrame, benchmark: DataFrame, text: str, span: int, k: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, bool] | None:
    """All places of windows in documents, the windows with their items, and whether the benchmark is small; None without windows."""
    worded = docs.select(_key(text), words_of(F.col(text)).alias("words"))
    items = durable(benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).withColumn("n", F.size("item_words")).where("n > 0"))
    # Every word stands in at most ``span`` windows, with a space and about 40 bytes of row for each window.
    size_of = F.octet_length(F.array_join("item_words", " ")) * F.lit(span) + F.col("n") * F.lit(40 + span)
    lengths = items.groupBy(F.when(F.col("n") < span, F.col("n")).otherwise(0).alias("size")).agg(F.sum(size_of).alias("bytes")).collect()
    if not lengths:
        return None
    small = sum(r.bytes for r in lengths) <= broadcast_bytes
    parts, origins = [], []
    for r in sorted(lengths, key=lambda r: r.size):
        windows = durable(_windows(items, r.size, span))
        parts.append(_occurrences(worded, items, windows, r.size, small, span, k))
        origins.append(windows)
    return durable(reduce(DataFrame.union, parts)), reduce(DataFrame.union, origins), small


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, and the items they come from.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``. A window
    is ``span`` consecutive words of an item, or a whole shorter item; every
    occurrence in a document counts. ``items_sha256`` is over the item ids as sorted
    strings, comma-joined.

    Defined cases: a null text has no words; items without words have no window;
    equal items each count; repeated rows give repeated results; rows of one
    ``doc_id`` with different texts are judged separately; an empty table gives an
    empty result, an empty benchmark no hits; other columns are ignored.
    """
    every = docs.select(_key(text), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    digest = lambda ids: F.sha2(F.array_join(ids, ",").cast("binary"), 256)
    none = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256")]
    places = _found(docs, benchmark, text, span, k, broadcast_bytes)
    if places is None:
        return every.select("key.doc_id", "n_words", *none, F.lit(False).alias("contaminated"))
    found, origin, small = places
    # A document's windows are at most as many as its words, for each of a few sizes.
    windows = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("windows"))
    covered = F.aggregate(
        "windows",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, w: F.struct(
            F.greatest(acc["upto"], w["start"] + w["size"]).alias("upto"),
            (acc["n"] + F.greatest(w["start"] + w["size"] - F.greatest(w["start"], acc["upto"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hits = windows.select("key", covered.alias("n_hit"))
    from_items = found.select("key", "window").distinct().join(F.broadcast(origin) if small else origin, "window")
    ids = from_items.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    said = hits.join(ids, "key").select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), digest(F.col("ids")).alias("items_sha256"))
    no_ids = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(said, "key", "left").select(
        "key.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", no_ids).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows in whose text a window of the benchmark stands.

    The windows and defined cases are those of ``contamination``; all columns are
    kept, whatever their names, and repeated rows stay or go together.
    """
    places = _found(docs, benchmark, text, span, k, broadcast_bytes)
    if places is None:
        return docs
    hit = durable(places[0].select("key").distinct())
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), _key(text))
    return rows.join(maybe_broadcast(hit, 64), "key", "left_anti").select("_row.*")
