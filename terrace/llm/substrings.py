"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors are ``ANCHOR``-word grams hashed only
at places in a difference cover modulo ``PERIOD``. For any two places there is a shift
below the period that brings both into the cover, so two equal windows hold an equal
anchor at equal shifts, and ``PERIOD - 1 + ANCHOR`` words are within a window. Anchors
that occur in more than one text are marked in a bit table of fixed size. They extend
to the windows that hold them; these alone are grouped, by 96 bits of hash, to find
the smallest document of each. A full table lets more windows through to the grouping
and changes no result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast

WINDOW = 13
# A short period makes anchors nearly as long as windows, so few others repeat.
PERIOD = 3
COVER = (0, 1)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of the table of repeated anchors: 64 MB in a task, whatever the size of the input; it is sent packed.
TABLE_BITS = 29
#: Anchors meet in buckets by their high bits, one for so many bytes of text; a task sends them in sorted runs of up to so many.
BUCKET_BYTES = 128 << 20
RUN_ANCHORS = 1_000_000
#: A window in so many rows is hot: its smallest document is joined apart, by broadcast while the hot ones are few.
HOT_ROWS = 5000
#: Spans to remove are broadcast up to this size; larger ones are joined by a shuffle.
SENT_BYTES = 48 << 20
KEPT_WORDS = 400_000

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k words from each place, of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _MULTIPLIERS[which]
        out += words[j : n + j]
    return _mixed(out)


def grams_at(words: np.ndarray, starts: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """``grams(words, k, which)[starts]``, without hashing all places where few are wanted."""
    if 4 * len(starts) > len(words):
        return grams(words, k, which)[starts]
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out *= _MULTIPLIERS[which]
        out += words[starts + j]
    return _mixed(out)


def _mixed(out: np.ndarray) -> np.ndarray:
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def anchor_places(n_words: int) -> np.ndarray:
    """Places of anchors in a text of so many words; texts without a window have none."""
    places = np.arange(n_words - ANCHOR + 1 if n_words >= WINDOW else 0)
    return places[np.isin(places % PERIOD, COVER)]


def _high(bits: int) -> int:
    """Bits of an anchor above its 32 low ones that are kept, for ``bits`` bits of bucket: 48 in all, or more where buckets need them."""
    return max(16, bits)


def _shortened(anchors: np.ndarray, bits: int) -> np.ndarray:
    return anchors.view(np.uint64) >> np.uint64(32 - _high(bits))


def _runs(found: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Shortened anchors, sorted: for each bucket the low halves, and how many there are of each high one.

    An anchor that is there more than once is kept twice.
    """
    values = _shortened(np.concatenate(found), bits)
    values.sort()
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    values = values[keep]
    high = (values >> np.uint64(32)).astype(np.int64)
    of_high = np.bincount(high, minlength=1 << _high(bits)).astype(np.int32)
    of_bucket = of_high.reshape(1 << bits, -1)
    sizes = of_bucket.sum(axis=1)
    there = np.flatnonzero(sizes)
    ends = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    low = pa.ListArray.from_arrays(ends(sizes[there]), pa.array(values.astype(np.uint32).view(np.int32)))
    many = pa.ListArray.from_arrays(ends(np.full(len(there), of_bucket.shape[1])), pa.array(of_bucket[there].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), low, many], ["bucket", "low", "sizes"])


def _anchors(bits: int):
    """Task: anchors of the texts, of each text once: ``(bucket, low, sizes)``."""

    def run(batches):
        hashes, found, n = WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = hashes.of(text)
                found.append(np.unique(grams(words, ANCHOR)[anchor_places(len(words))]))
                n += len(found[-1])
                if n >= RUN_ANCHORS:
                    yield _runs(found, bits)
                    found, n = [], 0
        if n:
            yield _runs(found, bits)

    return run


def _repeated(bits: int):
    """Task: shortened anchors that are there more than once; rows come bucket by bucket."""

    def ended(runs):
        values = np.sort(np.concatenate(runs))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(values[1:][values[1:] == values[:-1]]).view(np.int64))], ["anchor"])

    def run(batches):
        bucket, runs = None, []
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if runs and b != bucket:
                    yield ended(runs)
                    runs = []
                bucket = b
                low, sizes = (batch.column(k)[i].values.to_numpy() for k in (1, 2))
                high = np.repeat(np.arange(len(sizes), dtype=np.uint64) + np.uint64(b * len(sizes)), sizes)
                runs.append((high << np.uint64(32)) | low.view(np.uint32).astype(np.uint64))
        if runs:
            yield ended(runs)

    return run


def _table(repeated: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the ``anchor`` column, by the low bits of each; at most ``2 ** bits`` bits come to the driver."""
    place = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    words = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << max(bits - 6, 0), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which shortened anchors have their bit set."""
    place = anchors & np.uint64(64 * len(table) - 1)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _repeated_starts(words: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the windows that hold a marked anchor."""
    places = anchor_places(len(words))
    places = places[_marked(table, _shortened(grams(words, ANCHOR)[places], bits))]
    starts = (places[:, None] - np.arange(PERIOD)[None, :]).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= len(words) - WINDOW)])


def _windows(sent, bits: int):
    """Task: the windows that may repeat of each text that has some, ``(doc_id, mark, w1, w2, start)``, the last three arrays."""

    def run(batches):
        hashes, table = WordHashes(), np.frombuffer(zlib.decompress(sent.value), np.uint64)
        for batch in batches:
            rows, parts = [], []  # a window's key has 96 bits: a long and an int
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = hashes.of(text)
                starts = _repeated_starts(words, table, bits) if len(words) >= WINDOW else ()
                if len(starts):
                    rows.append(i)
                    parts.append((grams_at(words, starts, WINDOW), (grams_at(words, starts, WINDOW, 1) >> 32).astype(np.int32), starts.astype(np.int32)))
            if rows:
                ends = np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in zip(*parts)]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), *arrays], ["doc_id", "mark", "w1", "w2", "start"])

    return run


def _spans(batches):
    """Merge each row's removed window starts into spans: flat arrays of starts and ends."""
    for batch in batches:
        out = []
        for starts in batch.column(2).to_pylist():
            starts = np.unique(np.array(starts, np.int64))
            new = np.flatnonzero(np.diff(starts) > WINDOW) + 1
            begin, end = starts[np.r_[0, new]], starts[np.r_[new - 1, len(starts) - 1]] + WINDOW
            out.append(np.c_[begin, end].ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "mark", "spans"])


def _kept(batches):
    """Task: remove the spans of each row, or all words of a copy."""
    for batch in batches:
        texts, copies, spans = (batch.column(i).to_pylist() for i in (1, 2, 3))
        total, removed, rest, digest = [], [], [], []
        for text, copy, cut in zip(texts, copies, spans):
            words = (text or b"").split()
            keep = words
            if copy and len(words) >= WINDOW:
                keep = []
            elif cut:
                keep, at = [], 0
                for begin, end in zip(cut[::2], cut[1::2]):
                    keep += words[at:begin]
                    at = end
                keep += words[at:]
            left = b" ".join(keep)
            total.append(len(words))
            removed.append(len(words) - len(keep))
            rest.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
        columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(rest, pa.binary()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    table_bits: int = TABLE_BITS,
    hot_rows: int = HOT_ROWS,
    sent_bytes: int = SENT_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """Remove each word in a window that also starts in a document of smaller ``doc_id``.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` of every row, and ``kept``, the
    words left joined by spaces, with ``keep_text``. Windows are judged on the input.

    Exact copies of a text are set aside first: only the row of smallest ``doc_id``
    goes on, and the others lose all words (if they have a window). Defined cases: a
    null text has no words; a text of fewer than 13 words loses none; repeated rows
    (same ``doc_id``) do not remove each other; a row without ``doc_id`` neither
    removes nor loses words; an empty table gives an empty result; other columns are
    ignored.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    raw = F.col(text).cast("binary")
    marked = docs.select("doc_id", raw.alias("text"), F.xxhash64(raw).alias("mark"), F.xxhash64(F.lit("second"), raw).alias("mark2"))
    # Texts that more than one doc_id has, and the smallest of these.
    of_text = marked.where("doc_id is not null and text is not null").groupBy("mark", "mark2")
    copies = durable(of_text.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    joined = marked.join(maybe_broadcast(copies, 96, sent_bytes), ["mark", "mark2"], "left")
    is_copy: Column = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    texts = joined.where(~is_copy & F.col("doc_id").isNotNull()).select("text", "doc_id", "mark")

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(4 * tasks, size // BUCKET_BYTES).bit_length(), 24)
    anchors = texts.select("text").mapInArrow(_anchors(bits), "bucket int, low array<int>, sizes array<int>").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    table = _table(anchors.mapInArrow(_repeated(bits), "anchor bigint"), table_bits)
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
    schema = f"doc_id {doc_type}, mark bigint, w1 array<bigint>, w2 array<int>, start array<int>"
    of_text = durable(texts.mapInArrow(_windows(sent, bits), schema).withColumn("at", F.monotonically_increasing_id()))
    windows = of_text.select("doc_id", "at", F.inline(F.arrays_zip("w1", "w2", "start")))
    rows = F.count(F.lit(1)).alias("n")
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), rows)
    firsts = durable(firsts.where("first < last").drop("last"))
    # Rows of a hot window never meet in one task: they are at most one in hot_rows, so that many windows' firsts are small.
    hot = maybe_broadcast(firsts.where(F.col("n") >= hot_rows).select("w1", "w2", "first"), 64)
    cold = firsts.where(F.col("n") < hot_rows).select("w1", "w2", "first")
    keys = ["w1", "w2"]
    found = windows.join(hot, keys).union(windows.join(hot.drop("first"), keys, "left_anti").join(cold, keys)).where("doc_id > first")
    starts = found.groupBy("at").agg(F.collect_list("start").alias("starts"))
    # Repeated rows have the same starts.
    named = of_text.select("at", "doc_id", "mark").join(starts, "at").dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "starts")
    spans = durable(named.mapInArrow(_spans, f"doc_id {doc_type}, mark bigint, spans array<int>"))
    size = spans.agg(F.sum(F.size("spans") * 4 + 64)).first()[0] or 0
    spans = F.broadcast(spans) if size <= sent_bytes else spans
    cut = joined.select("doc_id", "text", is_copy.alias("copy"), "mark").join(spans, ["doc_id", "mark"], "left")
    out = cut.select("doc_id", "text", "copy", "spans").mapInArrow(
        _kept, f"doc_id {doc_type}, n_words bigint, n_removed bigint, kept binary, kept_sha256 string"
    )
    if keep_text:
        return out.withColumn("kept", F.col("kept").cast("string"))
    return out.drop("kept")
