"""Language-model scores from a subword lattice.

The pieces are those of an existing vocabulary. A word's probability is the sum over
all its segmentations into pieces, by a forward recursion in log space; a text is its
words and one end token. The vocabulary's own scores are the starting weights and stay
as prior counts; the pieces' weights are then re-estimated by expectation
maximisation on the distinct words of the training texts and their counts.

Words repeat, so they are scored once each. A word that makes at least one in
``SENT_SHARE`` of all tokens is sent to the tasks; there are at most so many. The
others, none of which is frequent, are joined by word. Texts are never shuffled, and
no table of all words is ever in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable

SPACE = "▁"  # marks the start of a word in the vocabulary
SENT_SHARE = 200_000
#: Longer words are joined, so that what is sent is bounded in bytes too.
SENT_WORD_BYTES = 64
ROUNDS = 3
#: Training words' prior: so many pieces, spread as the vocabulary's scores say.
PRIOR_PIECES = 5000.0
#: Words less likely than this are counted in logs.
SMALLEST = 1e-200


class Pieces:
    """The pieces of a sentencepiece vocabulary, an automaton over them, and their starting weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.single: set[str] = set()
        scores = np.full(self.n, np.nan)
        for i in range(self.n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.automaton.add_word(piece, (len(piece), i))
                scores[i] = model.get_score(i)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        # A merge vocabulary scores a piece by minus its rank; the weight falls as one over it.
        weight = 1.0 / (10.0 - np.where(np.isnan(scores), scores[~np.isnan(scores)].min(), scores))
        weight[[i for i in range(self.n) if np.isnan(scores[i]) and i not in set(self.bytes.values())]] = 0
        self.prior = weight / weight.sum()

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each end in the marked word: (start, pieces). A character that is no piece is spelled in byte pieces."""
        marked = SPACE + word
        ends: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(marked) + 1)]
        for end, (size, i) in self.automaton.iter(marked):
            ends[end + 1].append((end + 1 - size, (i,)))
        for at, c in enumerate(marked):
            if c not in self.single:
                ends[at + 1].append((at, tuple(self.bytes[b] for b in c.encode())))
        return ends


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top


def forward(ends, logs) -> list[float]:
    """Log probability of reaching each place of the word."""
    alpha = [0.0]
    for arcs in ends[1:]:
        alpha.append(_log_sum([alpha[start] + (logs[ids[0]] if len(ids) == 1 else sum(logs[i] for i in ids)) for start, ids in arcs]) if arcs else -math.inf)
    return alpha


def expected_counts(ends, logs, out, weight: float) -> None:
    """Add ``weight`` times the expected number of each piece in the word to ``out``."""
    alpha = forward(ends, logs)
    beta = [-math.inf] * len(ends)
    beta[-1] = 0.0
    pending: list[list[float]] = [[] for _ in ends]
    for end in range(len(ends) - 1, 0, -1):
        if end < len(ends) - 1:
            beta[end] = _log_sum(pending[end]) if pending[end] else -math.inf
        if beta[end] == -math.inf:
            continue
        for start, ids in ends[end]:
            cost = sum(logs[i] for i in ids)
            pending[start].append(cost + beta[end])
            p = weight * math.exp(alpha[start] + cost + beta[end] - alpha[-1])
            for i in ids:
                out[i] += p


def add_expected(ends, chances: list[float], logs: list[float], out: list[float], weight: float) -> None:
    """``expected_counts`` by plain products, which are far quicker and exact enough until they become tiny; then in logs."""
    alpha = [0.0] * len(ends)
    alpha[0] = 1.0
    for end, arcs in enumerate(ends):
        for start, ids in arcs:
            p = alpha[start]
            for i in ids:
                p *= chances[i]
            alpha[end] += p
    if alpha[-1] < SMALLEST:
        expected_counts(ends, logs, out, weight)
        return
    beta = [0.0] * len(ends)
    beta[-1] = weight / alpha[-1]
    for end in range(len(ends) - 1, 0, -1):
        b = beta[end]
        if b:
            for start, ids in ends[end]:
                p = b
                for i in ids:
                    p *= chances[i]
                beta[start] += p
                p *= alpha[start]
                for i in ids:
                    out[i] += p


def _reached(made: Pieces, word: str, chances: list[float]) -> tuple[list, list[float]] | None:
    """Pieces in the marked word by their last places, and the probability of reaching each place by plain products.

    None if a character is no piece or the products become tiny.
    """
    marked = SPACE + word
    if not made.single.issuperset(marked):
        return None
    found = list(made.automaton.iter(marked))
    alpha = [0.0] * (len(marked) + 1)
    alpha[0] = 1.0
    for last, (size, i) in found:
        alpha[last + 1] += alpha[last + 1 - size] * chances[i]
    return (found, alpha) if alpha[-1] >= SMALLEST else None


def add_word(made: Pieces, word: str, chances: list[float], logs: list[float], out: list[float], weight: float) -> None:
    """``add_expected`` for a word; without a list of arcs where each is one piece."""
    if not (way := _reached(made, word, chances)):
        add_expected(made.arcs(word), chances, logs, out, weight)
        return
    found, alpha = way
    beta = [0.0] * len(alpha)
    beta[-1] = weight / alpha[-1]
    for last, (size, i) in reversed(found):
        if b := beta[last + 1]:
            p = b * chances[i]
            beta[last + 1 - size] += p
            out[i] += p * alpha[last + 1 - size]


def log_chance(made: Pieces, word: str, chances: list[float], logs: list[float]) -> float:
    """The word's log probability, all segmentations summed."""
    way = _reached(made, word, chances)
    return math.log(way[1][-1]) if way else forward(made.arcs(word), logs)[-1]


def held_out(doc_id, of: int = 7, remainder: int = 2):
    """Column: the document is kept away from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches):
    """Counts of words in training texts and in all: ``(word, n, m)``."""
    for batch in batches:
        seen: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()
        for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[out].update(_words(text))
        train, held = seen
        words = [*train, *(w for w in held if w not in train)]
        counts = [train[w] for w in words], [train[w] + held[w] for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], ["word", "n", "m"])


def fit(vocabulary: DataFrame, texts: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces, the last entry being the end token's, from words and their counts.

    What comes to the driver are the pieces' expected counts, as many as the vocabulary has.
    """
    made = pieces_of(path)
    prior = np.append(made.prior * PRIOR_PIECES, 1.0)
    counts = np.append(np.zeros(made.n), float(texts))
    spark = vocabulary.sparkSession

    def weights(counts: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log((counts + prior) / (counts + prior).sum())

    train = vocabulary.where("n > 0")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights(counts).tolist())

        def expect(batches):
            made, logs = pieces_of(path), sent.value
            chances, sums = [math.exp(x) for x in logs], [0.0] * made.n
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    add_word(made, word.decode(errors="replace"), chances, logs, sums, n)
            out = np.array(sums)
            used = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["piece", "n"])

        found = train.select("word", "n").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.append(np.zeros(made.n), float(texts))
        for r in found:
            counts[r.piece] = r.n
    return weights(counts)


def score(docs: DataFrame, path: str, text: str = "text", sent_share: int = SENT_SHARE, rounds: int = ROUNDS, held=held_out) -> DataFrame:
    """Score every whole text with a model learned from the texts that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    Tokens are the words, A-Z lower-cased, and one end. ``base_score`` is the word
    model's log10 probability with one added to every count; ``score`` is the lattice
    model's. ``n_known`` tokens were seen in training.

    Defined cases: a null text is empty and has the end token alone; repeated rows
    are scored, and counted in training, each; with no training text at all the
    counts are zero and the lattice has its prior; an empty table gives an empty
    result; other columns are ignored.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("doc_id", F.col(text).cast("binary").alias("text"), held(F.col("doc_id")).alias("out"))
    counted = raw.select("text", "out").mapInArrow(_count, "word binary, n bigint, m bigint")
    vocabulary = durable(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("m").alias("m")).first()
    train = raw.where("not out").count()
    n_train, distinct = (totals.n or 0) + train, totals.v + bool(train)
    over = n_train + (distinct + 1)
    logs = fit(vocabulary, train, path, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(logs.tolist())
    ln10 = math.log(10.0)

    def weigh(batches):
        made, logs = pieces_of(path), sent.value
        chances = [math.exp(x) for x in logs]
        for batch in batches:
            n = np.asarray(batch.column(1), np.float64)
            own = [log_chance(made, w.decode(errors="replace"), chances, logs) / ln10 for w in batch.column(0).to_pylist()]
            columns = [pa.array(n > 0), pa.array(np.log10((n + 1) / over)), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["word", "m", "known", "base", "own"])

    weighed = durable(vocabulary.select("word", "n", "m").mapInArrow(weigh, "word binary, m bigint, known boolean, base double, own double"))
    is_sent = (F.col("m") * sent_share >= F.lit(totals.m or 0)) & (F.octet_length("word") <= SENT_WORD_BYTES)
    frequent = weighed.where(is_sent).select("word", "known", "base", "own").toArrow()
    frequent = dict(zip(frequent["word"].to_pylist(), zip(*(frequent[c].to_pylist() for c in ("known", "base", "own")))))
    scores = docs.sparkSession.sparkContext.broadcast(frequent)
    end = int(train > 0), math.log10((train + 1) / over), float(logs[-1]) / ln10

    def add_up(batches):
        of = scores.value
        for batch in batches:
            sums, rest, times = [], [], []
            for text in batch.column(2).to_pylist():
                words = Counter(_words(text))
                known, base, own = end
                others = []
                for word, k in words.items():
                    if found := of.get(word):
                        known += k * found[0]
                        base += k * found[1]
                        own += k * found[2]
                    else:
                        others.append(word)
                sums.append((sum(words.values()) + 1, known, base, own))
                rest.append(others)
                times.append([words[w] for w in others])
            n, known, base, own = zip(*sums) if sums else ((), (), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            lists = [pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *lists], ["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "word", "k"])

    schema = f"doc_id {doc_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, own double, word array<binary>, k array<bigint>"
    texts = durable(raw.select("doc_id", "out", "text").mapInArrow(add_up, schema).withColumn("at", F.monotonically_increasing_id()))
    rare = texts.select("at", F.inline(F.arrays_zip("word", "k"))).join(weighed.where(~is_sent), "word")
    more = rare.groupBy("at").agg(*(F.sum(F.col("k") * F.col(c).cast("double")).alias(f"more_{c}") for c in ("known", "base", "own")))
    joined = texts.drop("word", "k").join(more, "at", "left")
    total = lambda c, extra: F.col(c) + F.coalesce(F.col(extra), F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        total("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        total("base", "more_base").alias("base_score"),
        total("own", "more_own").alias("score"),
    )
