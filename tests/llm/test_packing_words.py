from __future__ import annotations

import gc
import random
import tracemalloc

import pyarrow as pa

from weftgraph.llm import packing

PATH = packing.tokenizer_path()


def distinct_words(n):
    rng = random.Random(5)
    kinds = ["{}", "{}.", "{}###", "é{}", "É{},", "{}'s", "{}7", "ж{}", "x́{}"]
    return [kinds[i % len(kinds)].format("".join(rng.choices("abcdefgh", k=9))) for i in range(n)]


def test_new_words_are_encoded_together():
    class Counting:
        def __init__(self, held):
            self.held, self.inputs = held, 0

        def encode_batch_fast(self, texts, **options):
            self.inputs += len(texts)
            return self.held.encode_batch_fast(texts, **options)

    own = packing.WordTokenizer(PATH)
    counting = {name: Counting(getattr(own, name)) for name in ("tokenizer", "letters") if hasattr(own, name)}
    vars(own).update(counting)
    own.encode(pa.array([" ".join(distinct_words(3000))]), 1)
    assert sum(c.inputs for c in counting.values()) <= 10


def test_known_words_take_few_bytes():
    own, words = packing.WordTokenizer(PATH), distinct_words(40_000)
    own.encode(pa.array(["a few words first"]), 1)
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, len(words), 1000):
        own.encode(pa.array([" ".join(words[i : i + 1000])]), 1)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * len(words)


def test_ids_of_odd_words_match_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    own = packing.WordTokenizer(PATH)
    texts = ["a\x01b \x01 c\x01", "\x01", "ÉTÉ... Öl### ß ÿ× ÷a", "it's. l'été', 'tis '' don't!", "a b   　", "é ́e ́", "<|startoftext|> x</w> </w>", "İI ſ ŉ ﬁ K", "x≠ ≮", "12a a12 ½ ٣", "_a_ a_ ~a a~ a`", "漢字。 かな, 한국어", " ".join(distinct_words(300))]
    for _ in range(2):
        for together in (texts, *[[t] for t in texts]):
            ids, ends = own.encode(pa.array(together), 1)
            for text, a, b in zip(together, ends[:-1], ends[1:]):
                assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids + [1], text


def test_ids_stay_right_when_known_words_are_forgotten(monkeypatch):
    words = distinct_words(500)
    texts = [" ".join(words[i : i + 50] + ["the", "of."]) for i in range(0, 500, 50)]
    expected = packing.WordTokenizer(PATH).encode(pa.array(texts), 1)[0].tolist()
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    own = packing.WordTokenizer(PATH)
    assert [i for t in texts for i in own.encode(pa.array([t]), 1)[0].tolist()] == expected
