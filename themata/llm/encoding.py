"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache of encoded words.

The library cuts a text into pieces by a pattern and merges within a piece only. A single space
between two characters that are not white space always begins a piece, so a text whose spaces all
stand like that has the ids of its space-separated words, each but the first with its space. Words
met before come from the cache; new ones go through the library, letters straight to its merge step.
Texts with other spaces, and texts that hold the string of a special token, go through the library as
a whole.
"""

from __future__ import annotations

from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

# White space as Unicode and Python have it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
#: A space beside white space, by the white space. Looking for each of them is faster than a pattern.
LOOSE = [(c, f"{c} ", f" {c}") for c in BLANKS if c != " "]
LOOSE_ASCII = [loose for loose in LOOSE if loose[0].isascii()]
#: Bounds of the cache in one worker process. A full cache keeps what it has, which includes the
#: frequent words; other and longer words are encoded again in each call.
CACHED_WORDS = 800_000
CACHED_LENGTH = 48


#: Punctuation that may follow letters. An apostrophe may begin a piece with letters, so it is not here.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level BPE writes each byte as a letter: printable ones as themselves, others from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHERS = [b for b in range(256) if b not in PRINTED]
BYTE_LETTERS = "".join(chr(256 + OTHERS.index(b)) if b in OTHERS else chr(b) for b in range(256))
SPACE_LETTER = BYTE_LETTERS[0x20]


class Words(dict):
    """The ids of words, each with a space before it; words that are not held are encoded when asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode
        #: Words of the present call that a full cache, or one for shorter words, does not take.
        self.passing: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.passing.get(word)
        if ids is None:
            ids = self.encode(word)
            held = self if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH else self.passing
            held[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The property makes a new object in each call.
        self.merge = self.library.model.tokenize
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = Words(self._fresh)
        self.tails: dict[str, bytes] = {"": b""}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _is_plain(self, text: str) -> bool:
        if text[:1] == " " or text[-1:] == " " or "  " in text:
            return False
        for blank, before, after in LOOSE_ASCII if text.isascii() else LOOSE:
            if blank in text and (before in text or after in text):
                return False
        return not any(s in text for s in self.specials)

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 1000:
                self.tails = {"": b""}
            self.tails[tail] = self.encode_whole([tail])[0]
        return self.tails[tail]

    def _piece(self, before: str, letters: str) -> bytes:
        """The ids of letters, which are one piece that the model merges by itself."""
        if not letters.isascii():
            letters = charmap_decode(letters.encode(), "strict", BYTE_LETTERS)[0]
        return array("I", [t.id for t in self.merge(before + letters)]).tobytes()

    def _fresh(self, word: str) -> bytes:
        """The ids of a word with a space before it."""
        stem = word.rstrip(TAIL)
        if stem.isalpha():
            if stem is word or stem == word:
                return self._piece(SPACE_LETTER, stem)
            ids = self.cache.get(stem)
            return (self._piece(SPACE_LETTER, stem) if ids is None else ids) + self._tail(word[len(stem) :])
        if "\n" in word:
            # A single line feed between such words is a piece.
            lines = word.split("\n")
            stems = [line.rstrip(TAIL) for line in lines]
            if all(map(str.isalpha, stems)):
                feed = self._tail("\n")
                rest = [
                    feed + self._piece("", stem) + self._tail(line[len(stem) :])
                    for line, stem in zip(lines[1:], stems[1:], strict=True)
                ]
                return self.cache[lines[0]] + b"".join(rest)
        return self.encode_whole([" " + word])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [text.split(" ") if self._is_plain(text) else [text] for text in texts]
        heads = self.encode_whole([w[0] for w in words])
        known = self.cache.__getitem__
        out = []
        for head, w in zip(heads, words, strict=True):
            out.append(head + b"".join(map(known, islice(w, 1, None))) if len(w) > 1 else head)
        self.cache.passing.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def forget_encoders() -> None:
    """Let go of the words that an earlier stage has met in this worker."""
    encoder.cache_clear()
