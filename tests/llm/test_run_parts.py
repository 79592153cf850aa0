"""Parts of tokenizers whose pre-tokens are runs of letters, digits or other marks, and files written from slices of batches."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from wiretide.llm import tokens as T
from wiretide.llm.bitpack import SLICE_BYTES, read_token_files, write_token_files
from wiretide.llm.common import scratch_dir

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"abAZst'''  ..,\"-<>|_09\n\n\t\r", *map(chr, (0x0B, 0x0C, 0x1C, 0x7F, 0x85, 0xA0, 0xAA, 0xB2, 0xB5, 0xC0, 0xD7, 0xE9, 0xED, 0xF7, 0xFF, 0x100, 0x301, 0x663, 0x2028, 0x3000, 0x6F22, 0x1F600))]
PIECES += [" the", " Émuíà", "'s", "'re", "'LL", " 's", "...", " 2024", "\r\n", "\n\n", " \n", "\n ", "  ", "<|endoftext|>", "<|endof", "text|>", " <|endoftext|> "]


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(BYTE).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def part_ids(texts):
    return [ids[a:b].tolist() for _, ids, offs in T.token_ids(pa.array(texts), BYTE) for a, b in zip(offs[:-1], offs[1:], strict=True)]


def test_parts_end_only_where_the_library_ends_them():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(20000)] + ["<|endof", "text|>", "", None, "x" * 5000, "-" * 5000, "\n" * 5000 + "a", " " * 5000]
    want = library_ids(texts)
    assert part_ids(texts) == want
    assert T.token_counts(pa.array(texts), BYTE).tolist() == [len(w) for w in want]


def test_a_word_is_one_part_whatever_stands_around_it():
    enc = T.PartEncoder.get(BYTE, True)
    enc.forget()
    texts = ["so wordy, wordy. wordy\nso wordy... wordy's wordy-so wordy2 wordy <|endoftext|> wordy\n\nÉmu émuà! émuà", "so wordy;"]
    assert part_ids(texts) == library_ids(texts)
    assert sorted(enc.at) == sorted([b"so", b" wordy", b",", b".", b"\n", b"...", b"'s", b"-", b"2", b" <|endoftext|>", b"\n\n\xc3\x89mu", b" \xc3\xa9mu\xc3\xa0", b"!", b";"])


def test_special_strings_of_letters_are_found(tmp_path):
    lib = Tokenizer.from_file(BYTE)
    lib.add_special_tokens(["ord"])
    lib.save(path := str(tmp_path / "t.json"))
    texts = ["a wordy, ord ord.", " ordord word"]
    got = [ids[a:b].tolist() for _, ids, offs in T.token_ids(pa.array(texts), path) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_long_parts_are_let_go(monkeypatch):
    monkeypatch.setattr(T, "HELD_IDS", 10_000)
    enc = T.PartEncoder.get(BYTE, True)
    enc.forget()
    for i in range(20):
        texts = [chr(0x4E00 + i) * 3000]
        assert part_ids(texts) == library_ids(texts)
    assert enc.used < 30_000
    enc.forget()


def test_batches_of_several_slices_keep_their_ids(spark):
    rng = random.Random(3)
    word = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    texts = [" ".join(rng.choices(word, k=k)) for k in (3, SLICE_BYTES // 10, 5, SLICE_BYTES // 10, 2, SLICE_BYTES // 3, 1, 4)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    back = read_token_files(write_token_files(docs, f"{scratch_dir(spark)}/t-slices", BYTE, 2, partitions=1)).collect()
    place = 0
    for i, (r, ids) in enumerate(zip(sorted(back, key=lambda r: r.id), library_ids(texts), strict=True)):
        want = np.array([*ids, 2], "<u4")
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (i, place, len(want), zlib.crc32(want.tobytes()))
        place += len(want)
