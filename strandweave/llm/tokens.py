"""Token ids of whole texts by a public tokenizer file, with a cache of words."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Words of one generation of a worker's cache; it holds the current and the last one.
CACHED_WORDS = 700_000
#: Words that are encoded in one call, as one text.
JOINED = 4000
_ENCODERS: dict[tuple, WordEncoder] = {}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    For a file whose words are encoded one by one (white space dropped, lower
    case), a text of plain Latin-1 letters is split here and only unseen words
    go to the tokenizer; any other text is encoded by the tokenizer as a whole.
    Strings of added tokens inside a text get the ids of these tokens, as the
    tokenizer gives them (a text that holds one, in any case of letters, goes
    to it whole); with ``specials_as_text`` those of special tokens are
    ordinary text.
    """

    def __init__(self, path: str, by_word: bool, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.strip().lower() for t in added if not (t.special and specials_as_text)]
        self.by_word = by_word
        self.cache: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        latin = [chr(c) for c in range(0x20, 0x7F)] + [chr(c) for c in range(0xA1, 0x100) if c != 0xAD]
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.plain = bytes(ord(c) for c in latin) + b"\t\n\r"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")

    def _is_plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.plain)
        except UnicodeEncodeError:
            return False

    def _split(self, text: str) -> list[str] | None:
        """The words of a text that can be encoded one by one, else None."""
        if not (self.by_word and self._is_plain(text)):
            return None
        low = text.lower()
        return None if any(a in low for a in self.added) else self.words.findall(low)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.last = {}, self.cache
        cache = self.cache
        missing = {w for ws in split if ws for w in ws if w not in cache}
        known = missing & self.last.keys()
        cache.update((w, self.last[w]) for w in known)
        unseen = list(missing - known)
        for lo in range(0, len(unseen), JOINED):
            part = unseen[lo : lo + JOINED]
            cache.update(zip(part, self._word_ids(part)))
        whole = iter(self._ids([t for t, ws in zip(texts, split) if ws is None]))
        get = cache.__getitem__
        return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in split]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer would split off in any text: encoded together, cut at its word numbers."""
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        numbers = np.array(made.word_ids, np.int64)
        if not len(numbers) or numbers[-1] != len(words) - 1:
            return self._ids(words)
        raw = np.array(made.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(numbers, np.arange(len(words) + 1))).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str, by_word: bool = True, specials_as_text: bool = False) -> WordEncoder:
    key = (path, by_word, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]
