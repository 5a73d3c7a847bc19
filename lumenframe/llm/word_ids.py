"""Token ids of whole texts, from the tokenizers library, each distinct word encoded once.

The vocabulary drops white space, and its splitting rule makes words of letters, single digits
and runs of other characters. Texts of Latin-1 letters and ASCII are cut so as arrays of bytes, and
a distinct word goes to the library's model once: most words occur again and again, and their
ids are kept. A space-separated chunk that holds anything else, or an apostrophe, is a word of its
own: if it is simple the splitting rule itself cuts it, and any other goes to the library as
it is. A tokenizer file with other rules than these gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries that a worker keeps of each kind. Longer keys than LONG are not kept, so an entry has at most some 250 bytes, mostly 40.
KEPT_CHUNKS, KEPT_WORDS = 200_000, 600_000
LONG = 48
#: Texts are encoded about so many characters at a time.
SOME_CHARS = 9_000_000
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
#: Printable ASCII and Latin-1 without the no-break space: no character of it combines with another or changes under NFC.
SIMPLE = re.compile(r"[\x21-\x7E\xA1-\xFF]+")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
#: What the tokenizer file must say for the rules above to be its own (fixed values of the public vocabulary file).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Kinds of bytes. Those of Latin-1 letters, C3 and the byte after it, are told apart in _cut.
SPACE, LETTERS, DIGIT, OTHER, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _KIND[0xC3] = LETTERS
_KIND[ord("'")] = ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The byte-level alphabet: bytes that are no printable character of Latin-1 stand as U+0100 and up, in their order.
_SHIFTED = {chr(b): chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_SHIFTED_HIGH = [(b, c) for b, c in _SHIFTED.items() if b >= "\x80"]


def _array(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(data)])


class _Kept:
    """Keys and their ids. Beyond `most`, the keys used most often stay; a key's uses count half at every such cut."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.ids, self.used = pa.array([], pa.binary()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def find(self, keys: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> tuple[pa.Array, np.ndarray]:
        """ids, and for each key their place; what is not known is learned."""
        n = len(self.keys)
        d = pa.concat_arrays([self.keys, keys]).dictionary_encode()  # kept keys are distinct and keep their places
        at = d.indices.to_numpy()[n:]
        every, ids = d.dictionary, self.ids
        if len(every) > n:
            ids = pa.concat_arrays([ids, learn(every[n:])])
        used = np.bincount(at, minlength=len(every))
        used[:n] += self.used
        self.keys, self.ids, self.used = every, ids, used
        long = np.diff(np.frombuffer(every.buffers()[1], np.int32)[every.offset : every.offset + len(every) + 1]) > LONG
        if len(every) - long.sum() > self.most:
            stay = np.flatnonzero(~long)
            self._keep(np.sort(stay[np.argpartition(-used[stay], self.most // 2)[: self.most // 2]]))
            self.used >>= 1
        elif long.any():
            self._keep(np.flatnonzero(~long))
        return ids, at

    def _keep(self, places: np.ndarray) -> None:
        self.keys, self.ids, self.used = self.keys.take(pa.array(places)), self.ids.take(pa.array(places)), self.used[places]


class WordEncoder:
    """ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        said = json.loads(self.whole.to_str())
        self.by_word = all(said.get(k) == v for k, v in RULES.items()) and said["model"].get("end_of_word_suffix") == "</w>"
        self.model = self.whole.model
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks and words: results stay the same, memory shrinks."""
        self.chunks, self.words = _Kept(KEPT_CHUNKS), _Kept(KEPT_WORDS)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in the byte-level alphabet, one after the other, and how many each has."""
        tokenize, ids, n = self.model.tokenize, [], []
        for w in words:
            tokens = tokenize(w)
            ids += [t.id for t in tokens]
            n.append(len(tokens))
        return np.array(ids, "<u4"), np.array(n, np.int64)

    def _learn_words(self, keys: pa.Array) -> pa.Array:
        text = b"\n".join(keys.to_pylist()).decode("latin-1")  # a character for each byte
        if not text.isascii():
            for b, c in _SHIFTED_HIGH:
                text = text.replace(b, c)
        ids, n = self._of_words(text.split("\n"))
        return _array(ids, 4 * n)

    def _learn_chunks(self, keys: pa.Array) -> pa.Array:
        texts = [k.decode() for k in keys.to_pylist()]
        cut = [PIECE.findall(t.lower()) if "<|" not in t and SIMPLE.fullmatch(t) else None for t in texts]
        words = list(set().union(*filter(None, cut)))
        table = str.maketrans(_SHIFTED)
        ids, n = self._of_words([w.encode().decode("latin-1").translate(table) for w in words])
        raw, ends = ids.tobytes(), np.cumsum(4 * n).tolist()
        known = {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends)}
        direct = iter(self._direct([t for t, c in zip(texts, cut) if c is None]))
        out = [next(direct) if c is None else b"".join([known[w] for w in c]) for c in cut]
        return pa.array(out, pa.large_binary())

    def _some(self, texts: list) -> list[bytes]:
        raws = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        keys, odd, at = _cut(b"\n".join([*raws, b""]))
        ends = np.searchsorted(at, np.cumsum([len(r) + 1 for r in raws]))
        if odd is None:
            ids, place = self.words.find(keys, self._learn_words)
        else:
            place = np.empty(len(keys), np.int64)
            ids, place[~odd] = self.words.find(keys.filter(pa.array(~odd)), self._learn_words)
            more, own = self.chunks.find(keys.filter(pa.array(odd)), self._learn_chunks)
            place[odd] = own.astype(np.int64) + len(ids)
            ids = pa.concat_arrays([ids, more])
        found = ids.take(pa.array(place))
        if not len(found):
            return [b""] * len(texts)
        offsets, data = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset), memoryview(found.buffers()[2])
        ends = offsets[ends].tolist()
        return [bytes(data[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_many(self, texts: list) -> list[bytes]:
        """The ids of each whole text; none for null."""
        if not self.by_word:
            return self._direct([(t or "").encode("utf-8", "replace").decode() for t in texts])
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= SOME_CHARS:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def _cut(data: bytes) -> tuple[pa.Array, np.ndarray | None, np.ndarray]:
    """Of UTF-8 text that ends in a space: its words, in lower case, and odd chunks as they are; which are odd, if any is; and where each begins."""
    buf = np.frombuffer(data, np.uint8)
    kind, low = (np.frombuffer(bytearray(data).translate(table), np.uint8) for table in (_KIND.tobytes(), _LOWER.tobytes()))  # several times as fast as indexing
    high = np.flatnonzero(buf > 0x7F)
    if len(high):
        b, before = buf[high], buf[high - 1]  # a byte after the first of a character has that before it
        latin = (before == 0xC3) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)  # letters but the signs of multiplication and division
        kind[high[latin]] = LETTERS
        low[high[latin & (b < 0x9F)]] += 32
    marks = np.flatnonzero(buf[:-1] == ord("<"))
    kind[marks[buf[marks + 1] == ord("|")]] = ODD  # a special token may begin
    space = kind == SPACE
    strange = kind.max(initial=SPACE) == ODD
    if strange:
        spaces = np.flatnonzero(space)
        chunk = np.searchsorted(spaces, np.flatnonzero(kind == ODD))
        chunk = chunk[np.flatnonzero(np.diff(chunk, prepend=-1))]
        step = np.zeros(len(buf) + 1, np.int8)
        step[np.where(chunk > 0, spaces[chunk - 1] + 1, 0)] = 1
        step[spaces[chunk]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        kind[inside] = ODD
        low = np.where(inside, buf, low)
    first = kind == DIGIT
    first[:1] = True
    first[1:] |= kind[1:] != kind[:-1]
    first &= ~space
    at = np.flatnonzero(first)
    kept = np.compress(~space, low)
    offsets = np.append(at - np.cumsum(space, dtype=np.int32)[at], len(kept)).astype(np.int32)
    keys = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return keys, kind[at] == ODD if strange else None, at


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
