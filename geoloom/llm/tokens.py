"""Token ids of whole texts with public vocabulary files, word by word from a cache where the vocabulary allows it."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import cache

_TAIL = b".,;:!?"


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class WordBpe:
    """Ids of a vocabulary whose tokens never reach across white space, as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space before it splits a text, so a text's ids are those of its words in a row. Words
    repeat, so their ids are looked up; the table of words is emptied when it holds ``most`` of them, which bounds memory
    without a change to the result. It also splits letters from punctuation, so a word's closing punctuation is looked up
    by itself; and it lower-cases, so texts in ASCII alone are lower-cased before they are looked up. A new word of
    letters alone goes to the bare model, in the vocabulary's byte alphabet, past the steps that would leave it as it is.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.most = most
        self.known: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return self.ids_of([text.encode("utf-8", "replace")])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts in UTF-8; unknown words are looked up together, so pass a few hundred texts at a time."""
        split = [(t.lower() if t.isascii() else t).split() for t in texts]
        look = self.known.get
        found = [list(map(look, words)) for words in split]
        open_texts = [(words, ids) for words, ids in zip(split, found, strict=True) if None in ids]
        if open_texts:
            new = {w for words, ids in open_texts for w, i in zip(words, ids, strict=True) if i is None}
            if len(self.known) + len(new) > self.most:
                self.known.clear()
            self._learn(new)
            for words, ids in open_texts:
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = look(words[at])
        return [b"".join(ids) for ids in found]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        ending, plain, other = [], {}, []
        for w in new:
            if w.isalpha():
                plain[w] = w.lower().decode()
            elif w[-1] in _TAIL and (stem := w.rstrip(_TAIL)) and stem[-1] < 128 and stem[-1:].isalnum():
                ending.append((w, stem))
            else:
                other.append(w)
        rest = {part for w, stem in ending for part in (stem, w[len(stem) :])}
        other += [w for w in rest if w not in known and w not in plain and w not in new]
        hard = []
        for w in other:
            letters = _plain(w)
            if letters:
                plain[w] = letters
            else:
                hard.append(w)
        found = self.bare.encode_batch_fast(list(plain.values()), add_special_tokens=False)
        found += self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in hard], add_special_tokens=False)
        for w, e in zip([*plain, *hard], found, strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w, stem in ending:
            known[w] = known[stem] + known[w[len(stem) :]]


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


_ALPHABET = _byte_alphabet()


def _plain(word: bytes) -> str | None:
    """The word lower-cased in the byte alphabet, if it is of letters alone that the vocabulary's steps treat alike."""
    if word.isascii():
        return word.decode().lower() if word.isalpha() else None
    text = word.decode("utf-8", "replace")
    if not text.isalpha() or "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return None
    return text.lower().encode().decode("latin-1").translate(_ALPHABET)
