"""Token ids through the ``tokenizers`` library with a bounded cache of words.

A tokenizer file of the form below drops white space and cuts letters, single digits and signs apart before its BPE model sees them, so the
ids of a text are the ids of its words in order, and a word needs to be encoded once per worker. Blanks may be put wherever the
pre-tokenizer cuts anyway, and Latin capitals may be lower-cased beforehand, as the normalizer does so itself: fewer different words are left.
Texts are looked at together: their words are numbered by Arrow and each different one is looked up once. Those of them that are new and of
Latin letters are one piece each and go to the library's BPE model as one text, with the digit 0 between them, whose id no letter gives; every
other word passes the whole tokenizer.
Texts that hold an added token (in any case) pass it word by word as they are, and so do whole texts
if the file has another form.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Words kept per Python worker (about 200 bytes each), in two generations; the older one goes when the younger is full.
CACHE_WORDS = 500_000
#: Longer words are encoded whenever they come; bytes of text looked at together.
LONGEST, SEGMENT = 64, 1 << 21

# The form of a file whose texts may be encoded by words.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Latin letters that are in normal form C and lower-case one by one; the dotted capital I does not.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ȿ]+")
#: Stands between words that are encoded as one text.
_BETWEEN = b" 0 "
_encoders: dict[str, "WordEncoder"] = {}

OTHER, LETTER, DIGIT, SIGN, QUOTE = range(5)


def _kinds() -> np.ndarray:
    """The kind of each byte; bytes beyond ASCII are letters if they belong to U+00C0 to U+023F (exceptions are put right by ``spaced``)."""
    kind = np.full(256, OTHER, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SIGN
    kind[0xC3:0xC9] = LETTER
    return kind


_KIND = _kinds()
_CUT = np.zeros((5, 5), dtype=bool)
for _a, _b in ((LETTER, DIGIT), (LETTER, SIGN), (LETTER, QUOTE), (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, SIGN), (DIGIT, QUOTE), (SIGN, LETTER), (SIGN, DIGIT), (QUOTE, DIGIT)):
    _CUT[_a, _b] = True
_CUTS = _CUT.ravel()


_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of a text and where each begins. It is cut at blanks and wherever the pre-tokenizer cuts between characters of ASCII and Latin letters."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[raw]
    if not data.isascii():
        wide = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC8))
        second = raw[wide + 1]
        lead = raw[wide]
        # not letters: the signs of multiplication and division; not one letter in lower case: the dotted capital I
        no = ((lead == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((lead == 0xC4) & (second == 0xB0))
        kind[wide + 1] = kind[wide] = np.where(no, OTHER, LETTER)
    ink = ~_IS_BLANK[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | _CUTS[kind[:-1] * np.uint8(5) + kind[1:]]
    at = np.flatnonzero(begins)
    solid = raw[ink]
    offsets = np.append(np.flatnonzero(begins[ink]), len(solid)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]), at


def _byte_letters() -> np.ndarray:
    """The byte-level alphabet as code points: printable bytes and blanks stand for themselves, the others follow from code point 256 on."""
    out = np.arange(256, dtype="<u2")
    others = [b for b in range(256) if b not in {*range(32, 127), *range(161, 173), *range(174, 256)}]
    # the blank is the 33rd of the alphabet's others, but it only separates words here
    out[others] = [256 + k + (b > 32) for k, b in enumerate(others)]
    return out


_LETTERS = _byte_letters()


def _as_bytes(values: pa.BinaryArray) -> list[bytes]:
    if not len(values):
        return []
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    whole = data.to_pybytes()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


class _Words(dict):
    """Ids of words as bytes, learned at first sight."""

    def __init__(self, tokenizer, dtype: np.dtype, most: int):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        plain = Tokenizer(tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces = lambda text: plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
        self.code, self.dtype = {2: "H", 4: "I"}[dtype.itemsize], dtype
        self.older: dict[bytes, bytes] = {}
        self.half = most // 2
        zero = self.whole("0")
        self.between = zero[0] if len(zero) == 1 else None

    def ids(self, word: bytes) -> bytes:
        """The ids of a word as the whole tokenizer gives them."""
        return array(self.code, self.whole(word.decode())).tobytes()

    def all_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words, which differ."""
        out = list(map(self.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        if new and self.older:
            for k in new:
                ids = out[k] = self.older.get(words[k])
                if ids is not None:
                    self[words[k]] = ids
            new = [k for k in new if out[k] is None]
        for k, ids in zip(new, self._learned([words[k] for k in new]), strict=True):
            out[k] = ids
            if len(words[k]) <= LONGEST:
                self[words[k]] = ids
        return out

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are not known yet."""
        plain = [w for w in words if w.isalpha() or _LATIN.fullmatch(w.decode())] if self.between is not None else []
        known: dict[bytes, bytes] = {}
        if plain:
            text = _BETWEEN.join(plain)
            if not text.isascii():
                text = text.decode().lower().encode()
            letters = text.decode() if text.isascii() else _LETTERS[np.frombuffer(text, dtype=np.uint8)].tobytes().decode("utf-16-le")
            coded = np.array(self.pieces(letters), dtype=self.dtype)
            ends = np.append(np.flatnonzero(coded == self.between), len(coded)).tolist()
            if len(ends) == len(plain):
                data, width, last = coded.tobytes(), self.dtype.itemsize, 0
                for word, end in zip(plain, ends, strict=True):
                    known[word] = data[last * width : end * width]
                    last = end + 1
        return [known[w] if w in known else self.ids(w) for w in words]

    def bound(self) -> None:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added, model = said["added_tokens"], said["model"]
        self.by_words = all(said[k] == v for k, v in FORM.items()) and model["type"] == "BPE" and not model["dropout"] and all(not a["normalized"] for a in added)
        self.added = [a["content"].encode().translate(_LOWER) for a in added]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.words = _Words(self.tokenizer, self.dtype, cache_words)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of the whole text; null counts as empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text. Short texts are looked at together, long ones in segments between words."""
        if not self.by_words:
            return [np.array(self.words.whole(t or ""), dtype=self.dtype) for t in texts]
        raw = [t.encode() if t else b"" for t in texts]
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for data in raw:
            if size + len(data) > SEGMENT and group:
                out += self._group(group)
                group, size = [], 0
            if len(data) > SEGMENT:
                out.append(np.concatenate([x for part in _segments(data) for x in self._group([part])]))
            else:
                group.append(data)
                size += len(data)
        if group:
            out += self._group(group)
        return out

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        low = [t.translate(_LOWER) for t in texts]
        special = [any(a in t for a in self.added) for t in low]
        low = [b"" if s else t for t, s in zip(low, special, strict=True)]
        found, at = words_of(b" ".join(low))
        coded = found.dictionary_encode()
        each = self.words.all_ids(_as_bytes(coded.dictionary))
        # the ids of the different words, and how many and from where on each has
        flat = np.frombuffer(b"".join(each), dtype=self.dtype)
        n = np.fromiter(map(len, each), dtype=np.int32, count=len(each)) // self.dtype.itemsize
        first = np.cumsum(n, dtype=np.int32) - n
        place = coded.indices.to_numpy()
        counts = n[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[place] - (ends - counts).astype(np.int32), counts) + np.arange(total, dtype=np.int32)]
        # texts end where the next one begins
        borders = np.cumsum(np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low)))
        until = np.append(0, ends)[np.searchsorted(at, borders)].tolist()
        self.words.bound()
        out = [ids[a:b] for a, b in zip([0, *until[:-1]], until, strict=True)]
        for k, s in enumerate(special):
            if s:
                out[k] = np.frombuffer(b"".join(map(self.words.ids, texts[k].split())), dtype=self.dtype)
        return out


def _segments(data: bytes) -> Iterator[bytes]:
    """Parts of about ``SEGMENT`` bytes, cut at blanks."""
    at = 0
    while at < len(data):
        m = _BLANK.search(data, at + SEGMENT)
        to = m.end() if m else len(data)
        yield data[at:to]
        at = to


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
