"""Word spans, hashes and piece-wise encoding against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from llm_cases import edge_rows  # noqa: F401  (fixtures)
from weblytics.llm import hashing as H
from weblytics.llm import tokens as K

TEXTS = [r[1] for r in edge_rows()]


def test_words_match_the_patterns(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT_BYTES", 1000)
    for kind, pattern, fold in (("nonspace", brute.WORD, None), ("alnum", brute.ALNUM, H.FOLD_AZ)):
        data, offsets = H.text_buffer(pa.array(TEXTS))
        words = H.words_of(data, offsets, H.word_class(kind), fold)
        want = [w for t in TEXTS for w in pattern.findall(brute.fold(t) if fold is not None else t or "")]
        raw = data.tobytes()
        got = [raw[s:e].decode() for s, e in zip(words.starts, words.ends)]
        assert [brute.fold(g) if fold is not None else g for g in got] == want
        assert np.diff(words.first).tolist() == [
            len(pattern.findall(brute.fold(t) if fold is not None else t or "")) for t in TEXTS]
        # equal words, and only those, have equal hashes
        assert len(set(zip(want, words.hashes.tolist()))) == len(set(want)) == len(set(words.hashes.tolist()))


def test_windows_stay_inside_documents():
    words = H.words_of(*H.text_buffer(pa.array(["a b c d", "", "e f", "a b c"])), H.word_class("nonspace"))
    assert words.windows_of(3).tolist() == [True, True, False, False, False, False, True]
    h = H.window_hashes(words.hashes, 3)
    assert h[0] == h[6] and len(set(h.tolist())) == len(h) - 1


def test_least_of_windows():
    from weblytics.llm.repeated_passages import sliding_least

    values = np.random.default_rng(0).integers(0, 1000, 300)
    for width in (1, 2, 3, 7, 26):
        want = [values[i:i + width].min() for i in range(len(values) - width + 1)]
        assert sliding_least(values, width).tolist() == want


def encode(texts):
    data, offsets = H.text_buffer(pa.array(texts, pa.string()))
    ids, at = K.Encoder(K.tokenizer_path()).encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_pieces_encode_like_whole_texts():
    tokenizer = K.load(K.tokenizer_path())
    texts = [t or "" for t in TEXTS]
    assert encode(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZé ñß\t\n'’.,!?0 9|#  İ日\x1c×÷")) | st.characters(
    blacklist_categories=("Cs",))), min_size=1, max_size=4))
def test_pieces_encode_like_whole_texts_on_any_text(texts):
    tokenizer = K.load(K.tokenizer_path())
    assert encode(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_sentence_ends():
    ends = K.sentence_ends(K.tokenizer_path())
    tokenizer = K.load(K.tokenizer_path())
    ids = tokenizer.encode("Yes. No, maybe\n", add_special_tokens=False).ids
    assert [bool(ends[i]) for i in ids] == [bool(re.search(r"[.!?\n]$", tokenizer.decode([i]))) for i in ids]
