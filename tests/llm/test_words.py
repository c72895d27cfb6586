"""Operator 13's words: what is remembered of them, and what they cost."""

import cProfile
import pstats

import public_tokenizers
import pytest

from fieldframe.llm import tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def whole(ours, texts):
    return [e.ids for e in ours.library.encode_batch(texts, add_special_tokens=False)]


def test_words_of_one_hash_keep_their_own_ids():
    # a word of two letters in the order of Thue and Morse, and the one with both letters exchanged: equal by any rolling hash modulo 2**64
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
    texts = [f"x {one} y", f"x {other} y", f"{other}, {one} {other}", "x y"]
    ours = tokens.Tokens(VOCABULARY)
    assert [x.tolist() for x in ours.encode(texts)] == whole(ours, texts)
    assert [x.tolist() for x in ours.encode(texts[::-1])] == whole(ours, texts[::-1])


def test_interpreted_calls_do_not_grow_with_words():
    def calls(n):
        ours, text = tokens.Tokens(VOCABULARY), " ".join(f"w{i}" for i in range(n))
        profile = cProfile.Profile()
        profile.enable()
        ours.encode([text])
        profile.disable()
        return pstats.Stats(profile).total_calls

    calls(10)
    assert calls(4000) < calls(400) + 1000


@pytest.mark.parametrize(("remembered", "at_once"), [(1 << 20, 4096), (3, 2), (1, 1)])
def test_words_are_met_again_and_forgotten(monkeypatch, remembered, at_once):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    monkeypatch.setattr(tokens, "AT_ONCE", at_once)
    ours = tokens.Tokens(VOCABULARY)
    texts = ["", " ", "\n", "it's ½ ä中𝒳 \x00 word", "a1b2\n\n c", "word 中 it", "𝒳" * 60 + " word", "\t \u0085x", "<|endoftext|>word<|endoftext|>"]
    for some in (texts, texts[::-1], texts[3:5], texts, [""], texts[5:] * 3):
        assert [x.tolist() for x in ours.encode(some)] == whole(ours, some)
