import random
from pathlib import Path

import numpy as np
import pytest

from strandline.llm import bpe

JSON = Path("/opt/tokenizers/byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not JSON.exists(), reason="no vocabulary here")

TEXTS = [
    "", " ", "  ", "\n", " \n x", "It's what they'll've 're 'r 'ree 's's ''s !'s x'S I'd'm", "'", "'l", "'ll", "a'l", "a'lx", "\t'v", "1'2'd3", "don't  stop\r\n\r\nnow   ",
    "naïve é ½ Ⅷ ٤٫٥ १२ 日本語。テスト 中文 ไทย ครับ 👩‍🔧👍🏽 ​⁠﻿\xad \xa0　x", "<|endoftext|> <|endoftext|>", "\x00\x1c\x1f a", "aaaa" * 300, "x" * 3000,
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(JSON))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_library(reference):
    rng = random.Random(3)
    alphabet = "'sStTrevlLdm  \n\t\r\xa0 .!?1²é́กx😀​\"_-"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(8000)]
    enc = bpe.Encoder()
    got = enc.encode_batch(texts)
    assert got == reference(texts)
    assert [enc.decode(ids) for ids in got] == texts


def test_scan_does_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 15, 5000).astype(np.uint8)
    state, want = bpe.FRESH, []
    for s in symbols:
        state = bpe.TRANSITIONS[s, state]
        want.append(state)
    for block in (1, 7, 64, 10_000):
        assert bpe.scan_states(symbols, block).tolist() == want


def test_offsets_cover_the_text():
    text = "naïve 日本 👍🏽 it's"
    spans = bpe.Encoder().offsets(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_query_on_nulls_empty_and_long_texts(spark, reference):
    rows = [(1, None, [0]), (2, "", [0]), (3, "Hello world", [0]), (4, "word " * 200_000, [0]), (3, "Hello world", [0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in bpe.token_ids(df).collect()), key=lambda x: x[0])
    assert [g[1] for g in got[:2]] == [None, []]
    assert got[2][1] == got[3][1] == reference(["Hello world"])[0]
    assert got[4][1] == reference(["word " * 200_000])[0]
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df.selectExpr("doc_id", "text", "1 n_tokens"), ["doc_id"]).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] == len(got[4][1])
    assert bpe.token_ids(df.limit(0)).count() == 0


def test_offsets_come_with_the_ids_and_decode_the_text(spark):
    rows = [(i, x) for i, x in enumerate([*TEXTS[:-1], None])]
    got = {r.doc_id: r for r in bpe.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), with_offsets=True).collect()}
    enc = bpe.Encoder()
    for i, text in rows:
        if text is None:
            assert got[i].ids is None and got[i].begin_bytes is None
            continue
        data = text.encode()
        ends = [*got[i].begin_bytes[1:], len(data)]
        assert [enc.ranks[data[a:b]] for a, b in zip(got[i].begin_bytes, ends)] == got[i].ids
