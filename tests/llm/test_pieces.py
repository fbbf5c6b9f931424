"""Chunks of texts that are encoded once."""

import random

import numpy as np

from corpusmill.llm import bpe, token_files
from corpusmill.llm.pieces import tokenizer_path

ODD = ["", " ", "\n", ".", " .", "a", " a.", "a.\nB, c", "it's 'tis x's. o'clock!", "a  b", "a \n b ", "x<|endoftext|>y.", "x\0y. z", "é, ß; ж. ж.", "a_b. a1. 1. 1a.", "ʼn. ˈa. ー. 一.", "x…", "a.. b?! c--", "\ta, \x0bb.", "w" * 70 + ". " + "w" * 64 + ".", "𞤀. 𞤀"]


def test_chunks_give_the_ids_of_whole_texts():
    r = random.Random(3)
    words = ["the", "The", "und", "é", "ж", "x's", "1", "a1", "\n", "", ".", "''", "'s"]
    texts = ODD + [" ".join(r.choice(words) + r.choice(["", ".", ",", "?!", "'", "...", "\n"]) for _ in range(r.randrange(40))) for _ in range(300)]
    whole = token_files.IdEncoder(tokenizer_path())
    expected = [np.array([*e.ids, 0], "<u2").tobytes() for e in whole.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for generation in (5, 300_000):
        parts, codec = token_files.IdEncoder(tokenizer_path()), bpe.Codec(tokenizer_path())
        parts.texts.chunks.size = codec.texts.chunks.size = generation
        for _ in range(2):
            assert list(parts.many(texts)) == expected
            assert [x.tobytes() + b"\0\0" for x in codec.many(texts)] == expected


def test_a_known_word_is_not_encoded_again_for_its_marks():
    encoder, sent = token_files.IdEncoder(tokenizer_path()), []
    encode = encoder.texts.encode
    encoder.texts.encode = lambda strings: sent.append("".join(strings)) or encode(strings)
    list(encoder.many(["x word other. ab,"]))
    sent.clear()
    assert len(encoder("y word, word. other, ab ab.")) == 2 * (1 + len(encoder.tokenizer.encode("y word, word. other, ab ab.").ids))
    assert "word" not in "".join(sent) and "other" not in "".join(sent) and "ab" not in "".join(sent)


def test_a_chunk_is_looked_up_once_in_many_texts():
    encoder, asked = token_files.IdEncoder(tokenizer_path()), []
    values = encoder.texts._values
    encoder.texts._values = lambda chunks: asked.extend(chunks) or values(chunks)
    texts = [f"word w{i} other" for i in range(1500)]
    expected = [np.array([*e.ids, 0], "<u2").tobytes() for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(encoder.many(texts)) == expected
    assert asked.count("other") == 1
