"""The encoder of the token operator gives the library's ids, with few calls of it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from deliverix.llm import token_output

CHARS = "abcdeABC  ..,,''12\n\t\r\x00\x1c\u0085\xa0éÉßøɏɐ²¼жя中文😀 %&-_"


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode_batch_fast(self, *a, **b):
        self.calls += 1
        return self.tokenizer.encode_batch_fast(*a, **b)


def same_as_library(encoder, plain, texts):
    got = [np.frombuffer(b, encoder.type).tolist() for b in encoder.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def made_texts(n, words):
    r = random.Random(7)
    some = ["".join(r.choices("abcdeéß.,'1\n", k=r.randint(1, 9))).strip() or "x" for _ in range(words)]
    texts = [" ".join(r.choices(some, k=r.randint(0, 60))) for _ in range(n)]
    return texts + ["".join(r.choices(CHARS, k=r.randint(0, 40))) for _ in range(n)] + ["", " ", "a", " a", "a ", "it's 's 't I'LL don't"]


def test_new_pieces_are_encoded_together():
    encoder = token_output.Encoder(token_output.tokenizer_path())
    encoder._words = Counting(encoder._words)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}," for i in range(5000))
    same_as_library(encoder, Tokenizer.from_file(token_output.tokenizer_path()), [text, text])
    assert encoder._words.calls == -(-5000 // token_output.PIECES)


@pytest.mark.parametrize("together", [1, 8])
def test_ids_are_the_librarys_whatever_is_kept(monkeypatch, together):
    for name, value in (("CACHE", 40), ("PIECES", 16), ("TEXTS", 3), ("TOGETHER", together)):
        monkeypatch.setattr(token_output, name, value)
    encoder, plain = token_output.Encoder(token_output.tokenizer_path()), Tokenizer.from_file(token_output.tokenizer_path())
    texts = made_texts(150, 200)
    for part in (texts, texts[::-1], [], texts[5:9]):
        same_as_library(encoder, plain, part)
        encoder.forget(10)
        assert len(encoder._rows) <= 10
    encoder.forget(0)
    same_as_library(encoder, plain, texts[:50])
    assert encoder.encode(pa.array(texts).slice(3, 20)) == encoder.encode(texts[3:23])


def test_merges_over_a_space(tmp_path):
    vocab = {c: i for i, c in enumerate([*token_output._BYTE_CHARS, "aĠ", "Ġb"])}
    t = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "Ġ"), ("Ġ", "b")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(path := str(tmp_path / "t.json"))
    encoder = token_output.Encoder(path)
    assert encoder._byte_level
    same_as_library(encoder, Tokenizer.from_file(path), ["a a b a ba ab", "b a", "a  b", *made_texts(20, 30)])


def test_tasks_of_a_worker_share_an_encoder():
    from pyspark import cloudpickle
    run = cloudpickle.loads(cloudpickle.dumps(token_output._encode(token_output.tokenizer_path(), 0)))
    token_output._ENCODERS.clear()
    list(run(iter([pa.record_batch([pa.array([1]), pa.array(["a b"])], names=["id", "text"])])))
    assert list(token_output._ENCODERS) == [token_output.tokenizer_path()]
