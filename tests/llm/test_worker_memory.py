"""What a Python worker keeps when its task is over."""

import public_tokenizers

from wiretide.llm import common
from wiretide.llm import tokens as T


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    assert list(common.tidied(lambda batches: (said.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert said == [1, 2, "back"]


def test_folded_forms_are_forgotten_sooner(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED_FOLDED", 3)
    enc = T.PartEncoder.get(public_tokenizers.path("word_bpe_49k.json"), True)
    enc.forget()
    enc.lookup([b" a", b" b", b" c", b" d"])
    enc.lookup([b" e"])
    assert list(enc.at) == [b" e"]
