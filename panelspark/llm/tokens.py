"""Token ids of whole texts, with the tokenizers library."""

from __future__ import annotations

import os
import string
import zlib

import numpy as np

# str.split() takes these for white space, the tokenizers do not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORDS_PER_CALL = 2_000
_LONG_WORD = 64

# Bytes as the letters of byte-level models: printable ones stand for themselves, the others for 256 and on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PROBES = ("word", "\u00c9cole,", "stra\u00dfe", "THE!!", "a.", "\u0142\u00f3d\u017a")


class _Memory(dict):
    """Ids of words; plain words are learned when first asked for, others are noted and stand as empty until then."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.other, self.gaps = learn, set(), False

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if ids is None:
            self.other.add(word)
            self.gaps = True
            return b""
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts word by word and remembers the ids of words, at most ``cache_words`` of them.

    For tokenizers that drop white space and lower the case: no token spans white space, so the ids of a
    text are those of its words in order. Most words are looked up. When the memory is full, only the
    words of the texts just encoded stay: the frequent ones are among them.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.known = _Memory(self._simple)
        # Ids as bytes. One more than the largest id is enough, as ids may have gaps.
        self.codes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        # Whether this tokenizer's model may be asked directly; _simple() says for which words.
        self.direct = True
        self.direct = all(self._simple(w) == self._whole(w) for w in _PROBES)
        self.recent: list[str] = []

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """One encoder per Python worker, kept from task to task."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_word_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def forget(self) -> None:
        """Keep only the words of the texts just encoded; also at the end of a task, as idle workers hold memory."""
        kept = {w: self.known[w] for text in self.recent for w in text.split() if w in self.known}
        self.known.clear()
        self.known.update(kept)
        self.recent = []

    def _model(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return b"".join([self.codes[t.id] for t in self.tokenizer.model.tokenize(letters)])

    def _simple(self, word: str) -> bytes | None:
        """Ids of Latin letters, with ASCII signs behind them or not: the pre-tokenizer makes one piece of
        each. Below U+0250 normal form and lower case go letter by letter. None for other words."""
        if not self.direct or len(word) > _LONG_WORD:
            return None
        base = word.rstrip(string.punctuation)
        if not base.isalpha() or not base.isascii() and (max(base) >= "\u0250" or "\u0130" in base):
            return None
        signs = word[len(base):]
        base = base.lower()
        if base == word:
            return self._model(word)
        ids = self._part(base)
        return ids + self._part(signs) if signs else ids

    def _part(self, part: str) -> bytes:
        if part not in self.known:
            self.known[part] = self._model(part)
        return self.known[part]

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), _WORDS_PER_CALL):
            part = words[i:i + _WORDS_PER_CALL]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(coded.word_ids, dtype=np.int64)
            raw = np.array(coded.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(owner, np.arange(1, len(part) + 1))).tolist()
            begin = 0
            for word, end in zip(part, ends):
                self.known[word] = raw[begin:end]
                begin = end

    def _whole(self, text: str) -> bytes:
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(coded.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null as empty."""
        known, out, plain, unfinished = self.known, [], [], []
        ids_of = known.__getitem__
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif any(c in text for c in _SEPARATORS):
                out.append(self._whole(text))
            else:
                # Fewer words to learn; "<|" may begin a special token, whose case counts.
                plain.append(text.lower() if text.isascii() and "<|" not in text else text)
                words = plain[-1].split()
                known.gaps = False
                out.append(b"".join(map(ids_of, words)))
                if known.gaps:
                    unfinished.append((i, words))
        if unfinished:
            new = sorted(known.other)
            known.other.clear()
            self._learn(new)
            for i, words in unfinished:
                out[i] = b"".join(map(ids_of, words))
            for word in new:
                if len(word) > _LONG_WORD:
                    known.pop(word, None)
        self.recent = plain
        if len(known) > self.cache_words:
            self.forget()
        return out


def crc32(raw) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF


def slices(batch, rows: int = 500):
    """Parts of an Arrow batch, so that a task holds few texts at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def grouped(batch, column: str, most_chars: int):
    """Parts of an Arrow batch, with the texts of a column, that end once they hold so many characters."""
    texts = batch.column(column).to_pylist()
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars or i == len(texts) - 1:
            yield batch.slice(begin, i + 1 - begin), texts[begin:i + 1]
            begin, size = i + 1, 0
