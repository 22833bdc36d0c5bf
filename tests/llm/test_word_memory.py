"""The words that op 5's tokenizer remembers: equal ids, and less work for words that come again."""

import random

import numpy as np
import public_tokenizers
import pytest

from cohortry.llm import packing


@pytest.fixture
def words():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.WordTokenizer(f.read())


def test_words_met_again_outlive_a_full_memory(words, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 64)
    asked = []
    merge = words._merge
    monkeypatch.setattr(words, "_merge", lambda pretoken: asked.append(pretoken) or merge(pretoken))
    often = ["often " * 3, "again again"]
    words.encode(often)
    for k in range(4):
        words.encode([" ".join("".join(random.Random(40 * k + j).choices("abcdefgh", k=9)) for j in range(40))])
        words.encode(often)
    assert asked.count("often") == asked.count("again") == 1


def test_ids_are_the_librarys_with_a_small_memory(words, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    monkeypatch.setattr(packing, "RUN_CHARS", 200)
    parts = ["a", "Zü", "IT'S", "don't", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\xad", ",", "...", "12", "_", "\x00", "<|endoftext|>", "</w>", "İ", "ǅ", "中文", "y" * 70]
    drawn = random.Random(3)
    texts = [None, "", " ", *["".join(drawn.choices(parts, k=drawn.randint(1, 30))) for _ in range(2000)]]
    wanted = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    found = [np.frombuffer(x, dtype="<u4").tolist() for k in range(0, len(texts), 500) for x in words.encode(texts[k : k + 500])]
    assert found == wanted
