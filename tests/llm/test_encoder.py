import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelith.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
OURS = WordEncoder(PATH, cache_words=50)

pieces = st.one_of(
    st.text(max_size=12),
    st.sampled_from(["Straße,", "ΑΣ", "ΑΣ.", "İstanbul", "été", "́x", "don't", "'s", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>5's", "a.b", "123,4", "a1b2", "'5", "''s", "l'll×x÷", "ĭĬİ.", "≮", "≮", "e̸.", "É-È_à", "x×.", "ȿɀ.", "ﬁn", "ǅ", "...", "ö!", "　", " x", "\x1cx"]),
    st.text(alphabet="abcéñßÜ.,!?", max_size=10),
)


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=8), st.sampled_from([" ", "\n", "\t ", "\x0b"]))
def test_words_give_the_ids_of_the_whole_text(words, gap):
    text = gap.join(words)
    text = text.encode("utf-8", "ignore").decode()
    assert OURS.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_edge_texts():
    assert OURS.by_words
    assert len(OURS.encode(None)) == len(OURS.encode("")) == len(OURS.encode(" \n")) == 0
    long = "word " * 50_000
    assert np.array_equal(OURS.encode(long), np.array(WHOLE.encode(long, add_special_tokens=False).ids))


def test_long_texts_pass_in_segments(monkeypatch):
    from panelith.llm import encoder

    monkeypatch.setattr(encoder, "SEGMENT", 100)
    texts = ["Über alles, " * 300, "x" * 5000, None, "a <|endoftext|> b " * 40, "", "1234 " * 10]
    for got, text in zip(OURS.encode_all(texts), texts, strict=True):
        assert got.tolist() == WHOLE.encode(text or "", add_special_tokens=False).ids


def test_other_forms_encode_whole_texts(tmp_path):
    import json

    said = json.load(open(PATH, encoding="utf-8"))
    said["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    text = "Some Words, and 12 MORE"
    assert WordEncoder(str(path)).encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_words_kept_by_a_worker_stay_under_80_mb():
    import sys

    enc = WordEncoder(PATH)
    letters = "bcdfghjklm"
    for k in range(0, 750_000, 50_000):
        enc.encode_all([" ".join("".join(letters[int(d)] for d in f"{n:07d}") for n in range(k, k + 50_000))])
    kept = [enc.words, enc.words.older]
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(w) + sys.getsizeof(ids) for w, ids in d.items()) for d in kept)
    assert size < 80_000_000, size


def test_new_words_pass_the_model_together():
    enc = WordEncoder(PATH)
    calls, pieces = [], enc.words.pieces
    enc.words.pieces = lambda text: calls.append(text) or pieces(text)
    texts = ["the Straße 0x0 école", "ĳ 10 École über x0y", None, "", "ﬁx ́ 'll don't"]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_all(texts)] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1
