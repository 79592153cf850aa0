"""Ids of folded parts against the library's ids of whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wiretide.llm import tokens as T

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [*"aAbBtTsSdDeEjJhHwWyYiIkKzZ'.,;:! \n\t\r0129<|>_-", *map(chr, (0x0B, 0x1F, 0, 0x85, 0xA0, 0xAA, 0xB5, 0xBA, 0xC0, 0xC9, 0xD0, 0xD7, 0xDE, 0xDF, 0xE9, 0xF7, 0xFF, 0x130, 0x131, 0x1C4, 0x1F0))]
PIECES += [*map(chr, (0x301, 0x307, 0x308, 0x30A, 0x30C, 0x331, 0x338, 0x3A3, 0x3C2, 0x1E96, 0x1E9E, 0x2009, 0x2019, 0x212A, 0x212B, 0x3000, 0x6F22, 0x1F600))]
PIECES += [" the", " The", ".", " word", " Ému", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "'s", "'RE", "'Ll", "... ", "\r\n", " \n"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_whole_texts(path):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(8000)] + ["", None, "a", "A.", ".", " "]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    got = [ids[a:b].tolist() for _, ids, offs in T.token_ids(pa.array(texts), path) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == want
    assert T.token_counts(pa.array(texts), path).tolist() == [len(w) for w in want]


def test_forms_of_a_word_are_encoded_once():
    enc = T.PartEncoder.get(WORD, True)
    enc.forget()
    texts = ["so Wordy wordy, WORDY. wordy\nWordy.\nÉmue émue, wordy.", "so wordy,"]
    assert len(np.concatenate([ids for _, ids, _ in T.token_ids(pa.array(texts), WORD)])) > 0
    assert sorted(enc.at) == sorted([b"so", b" wordy", b",", b".", " émue".encode()])
