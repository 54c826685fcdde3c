"""Token ids of whole texts inside tasks: every distinct word is tokenised once for each worker."""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; a memory bound only, forgotten words are tokenised again.
REMEMBERED = 600_000


def _all_letters(word: str) -> bool:
    """Letters that stay letters when composed and lower-cased; a mark that comes off would join what follows."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Known:
    """Ids of the words seen so far: a number for each word, and all ids in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.begin, self.used = np.zeros(1 << 14, np.int64), 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; letters before a last full stop or comma are looked up as a word of their own."""
        number = self.number
        new = [w for w in words if w not in number]
        if new:
            cores = {w: w[:-1] for w in new if w[-1:] in (".", ",") and _all_letters(w[:-1])}
            plain = [w for w in dict.fromkeys([*(cores.get(w, w) for w in new), *{w[-1] for w in cores}]) if w not in number]
            letters, rest = [w for w in plain if w.isalpha()], [w for w in plain if not w.isalpha()]
            for i in range(0, len(letters), 512):
                self._add_letters(letters[i : i + 512])
            if rest:
                self._add(rest, [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
            if cores:
                ids, size, begin = self.ids, self.size, self.begin
                at = [(number[c], number[w[-1]]) for w, c in cores.items()]
                self._add(list(cores), [[*ids[begin[i] : begin[i] + size[i]].tolist(), *ids[begin[j] : begin[j] + size[j]].tolist()] for i, j in at])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def _add_letters(self, words: list[str]) -> None:
        """Words of letters alone, in one call: each gives tokens up to the first that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words) or stop[-1] != len(ids):  # letters that fall into several tokens' words
            self._add(words, [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])
        else:
            self._add_flat(words, np.diff(np.r_[0, stop]), ids)

    def _add(self, new: list[str], lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        self._add_flat(new, size, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())))

    def _add_flat(self, new: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        n, m = len(self.number), len(self.number) + len(new)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while m > len(self.size):
            self.size, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.begin))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n:m], self.begin[n:m] = size, self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.number.update(zip(new, range(n, m)))


_known: dict[str, Known] = {}


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch of texts: their numbers in a dictionary, the dictionary, and where each text's words begin.

    Words are runs of bytes other than space and 0x09-0x0D; null counts as empty. Empty entries (white space at
    an end) may occur in the dictionary.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


def token_ids(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text begins (one entry more than texts).

    The tokenizer must never join across ASCII white space, as one that drops white space does; then the ids of a text are
    those of its words one after another. ``end_id`` follows every text.
    """
    known = _known.get(path) or _known.setdefault(path, Known(path))
    if len(known.number) > REMEMBERED:
        known.forget()
    index, dictionary, offsets = split_words(texts)
    offsets = offsets - offsets[0]
    number = known.numbers(dictionary.to_pylist())[index] if len(index) else np.zeros(0, np.int64)
    n, begin = known.size[number], known.begin[number]
    ends = np.cumsum(n)
    # where each text begins among its own ids; an end id follows every text
    bounds = np.r_[0, ends][offsets]
    extra = 0 if end_id is None else 1
    out = np.full(int(bounds[-1]) + extra * (len(bounds) - 1), end_id or 0, dtype=np.uint32)
    at = np.arange(int(bounds[-1])) - np.repeat(ends - n - begin, n)
    if not extra:
        out[:] = known.ids[at]
        return out, bounds
    shift = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out[np.arange(int(bounds[-1])) + shift] = known.ids[at]
    return out, bounds + np.arange(len(bounds))
