import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
import tiktoken

from terrace.llm import bpe
from terrace.llm.queries import TOKENIZER

TEXTS = [
    None, "", " ", "Hello, world's best\n\n  code\t", "naïve façade ½ ² ª × ÷ Ω", "日本語テキスト 😀👍🏽 e\u0301", "aaa" * 400, "ab " * 5000,
    "\x00\x1c\x1d\x85\u2028 x", "<|endoftext|>", "don't we'll I'VE", "  \n \n", "١٢٣ ४५", "ff\u200dz",
]


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(TOKENIZER), special_tokens={})


def test_ids_match_the_rank_rule(exact):
    codec = bpe.codec(TOKENIZER, public_tokenizers.PATTERN)
    rng = random.Random(3)
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 40))) for a in ("ab ", "a", "-= \n", "é€😀 ", "0a'st", "\u0301ßx") for _ in range(200)]
    pieces = list(codec.table.values())
    made += [b"".join(rng.choice(pieces) for _ in range(4)).decode(errors="replace") for _ in range(2000)]
    texts = [t or "" for t in TEXTS] + made
    for text, packed in zip(texts, codec.packed(texts)):
        want = exact.encode_ordinary(text)
        assert packed == struct.pack(f"<{len(want)}I", *want), text
        assert codec.decode(want) == text.encode()


def test_digests_and_round_trip(spark, exact):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, None, 1)], "doc_id int, text string, ids int")
    got = bpe.digests(docs, TOKENIZER, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = exact.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN), TOKENIZER, public_tokenizers.PATTERN).collect()
    assert all(r.decoded_text == (r.text or "") for r in back)
    assert bpe.digests(docs.limit(0), TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_offsets_cover_split_characters(spark):
    docs = spark.createDataFrame([(1, "x 😀y 日")], "doc_id int, text string")
    row = bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN, offsets=True).first()
    assert len(row.offsets) == len(row.ids)
    codec = bpe.codec(TOKENIZER, public_tokenizers.PATTERN)
    for i, span in zip(row.ids, row.offsets):
        piece = codec.table[i].decode(errors="ignore")
        assert piece in row.text[span.start : span.end] and span.end > span.start
    assert row.offsets[0].start == 0 and row.offsets[-1].end == len(row.text)


def test_encoding_stays_in_its_thread():
    """A task has one core: threads of the tokenizer's own would take several times the work's CPU seconds."""
    codec, rng = bpe.codec(TOKENIZER, public_tokenizers.PATTERN), random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(9)) for _ in range(50)) for _ in range(400)]
    every, own = time.process_time(), time.thread_time()
    codec.packed(texts)
    every, own = time.process_time() - every, time.thread_time() - own
    assert every < 1.3 * own
