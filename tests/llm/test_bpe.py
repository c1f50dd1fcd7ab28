"""Encoding and decoding against the library that reads the same vocabulary."""

import hashlib
import random

import numpy as np
import pytest

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import bpe
from velum.llm.queries import TOKENIZERS, VOCABULARY

PATH = f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    packed = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == want
    assert own.decode(packed) == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_odd_texts(own, library):
    same(own, library, ["", "  a  b", "\n\n a\t\tb \x1c\x1d x\x85y\xa0\xa0z", "<|endoftext|>a<|endoftext|> <|endoftext|>",
                        "don't I'LL we'll 'S ''s", "a" * 3000, "ab" * 999 + " ", "12½³ ٣٤ 中文字符", "x​y﻿", "a\0b\0"])


def test_random_texts(own, library):
    pick = random.Random(3)
    letters = "ab 1'\n\té中\x1c\xa0 !$<|🙂ś.,"
    same(own, library, ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(5000)])


def test_every_character(own, library):
    same(own, library, [f"a{chr(c)}1 {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000])


def test_one_by_one_and_together_merge_alike(own):
    words = ["hello", "indivisible", "aaaaaaaaaaaa", "zzqqxj", "ab"]
    first = own.first
    for w in words:
        assert bpe.merge_word([int(first[b]) for b in w.encode()], own.merges) == np.frombuffer(own.encode([w])[0], "<u4").tolist()


def test_forgetting_changes_nothing(own, monkeypatch):
    texts = [f"word{i} other{i * 7}" for i in range(500)]
    want = own.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    assert [own.encode([t])[0] for t in texts] == want and own.encode(texts) == want


def test_column(spark, docs, odd):
    v = bpe.read_vocabulary(spark, PATH)
    df = docs(odd, clash=True)
    rows = df.select("doc_id", "text", bpe.round_trip("text", v).alias("t"), bpe.decode(bpe.encode("text", v), v).alias("d")).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r.t.decoded == r.d == (r.text or "")
    assert docs([]).select(bpe.encode("text", v)).collect() == []


def test_query(spark, docs, odd, folder, library):
    from velum.llm.queries import QUERIES

    got = QUERIES["op4_bpe_round_trip"](spark, folder(documents=docs(odd))).collect()
    want = []
    for i, text in odd:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
