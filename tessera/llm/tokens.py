"""Tokenizing columns of text with the tokenizers library, word by word where that gives the same ids."""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import as_strings

#: Beyond this many a worker forgets the words that it has seen least.
MOST_WORDS = 350_000
#: ASCII signs that aren't letters, digits or white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words_are_independent(spec: dict) -> bool:
    """Whether ids of a text are those of its space-separated parts in a row: white space is folded before a split that drops it, and nothing is added around a text."""
    norms = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        all(x["type"] in ("NFC", "Replace", "Lowercase") for x in norms)
        and any(x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" for x in norms)
        and pre.get("type") == "Split" and pre.get("behavior") == "Removed" and bool(pre.get("invert"))
        and pre["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        and not any(c.isspace() for x in spec.get("added_tokens", []) for c in x["content"])
    )


class Encoder:
    """Ids of many texts at once.

    Where a tokenizer treats space-separated words independently, each distinct word is
    encoded by the library once and ids are gathered with numpy; otherwise whole texts go to the library.
    """

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _words_are_independent(spec) if by_word is None else by_word
        self.vocab_size = self.lib.get_vocab_size(with_added_tokens=True)
        if self.by_word:
            suffix = spec["model"].get("end_of_word_suffix") or ""
            self.by_word = bool(suffix)
            self.ends_word = np.zeros(self.vocab_size, bool)
            for token, i in self.lib.get_vocab(with_added_tokens=True).items():
                self.ends_word[i] = token.endswith(suffix)
        self.known: set[str] = set()  # letters that _splits was asked about
        self.unsafe: set[str] = set()
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}  # of a chunk; its ids are flat[at[code] : at[code] + size[code]]
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.size, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0
        self.seen = np.zeros(1 << 18, np.int32)  # in how many steps
        self.safe = np.zeros(1 << 18, bool)  # whether it is letters that the library cuts from the signs behind them

    def _prune(self) -> None:
        """Forget the chunks seen in the fewest steps, half of them or more."""
        seen = self.seen[: self.count]
        least = 2
        while (seen >= least).sum() > MOST_WORDS // 2:
            least += 1
        kept = {w: c for w, c in self.code.items() if seen[c] >= least}
        codes = np.fromiter(kept.values(), np.int64, len(kept))
        ids, sizes = self._gather(codes)
        counts, safe = seen[codes] // 2, self.safe[codes]
        self._clear()
        self._keep(list(kept), ids, sizes)
        self.seen[: self.count], self.safe[: self.count] = counts, safe

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember chunks whose ids are given in a row."""
        n, m = self.count + len(sizes), self.used + len(ids)
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * m - self.used, np.uint32)])
        if n > len(self.at):
            more = np.zeros(2 * n - self.count, np.int64)
            self.at, self.size = (np.concatenate([x[: self.count], more]) for x in (self.at, self.size))
            self.seen = np.concatenate([self.seen[: self.count], more.astype(np.int32)])
            self.safe = np.concatenate([self.safe[: self.count], more.astype(bool)])
        self.flat[self.used : m] = ids
        self.size[self.count : n] = sizes
        self.at[self.count : n] = self.used + np.cumsum(sizes) - sizes
        self.code.update(zip(chunks, range(self.count, n)))
        self.count, self.used = n, m

    def _gather(self, codes: np.ndarray, flat: np.ndarray | None = None, at: np.ndarray | None = None, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered chunks in a row, and each one's number; of other chunks, where ``flat``, ``at`` and ``size`` are given."""
        if flat is None:
            flat, at, size = self.flat, self.at, self.size
        n = size[codes]
        ends = np.cumsum(n)
        where = np.repeat(at[codes] - ends + n, n)
        where += np.arange(len(where))
        return flat[where], n

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _splits(self, c: str) -> bool:
        """Whether the library itself keeps this letter in one piece with a letter next to it, cuts it from a sign behind it, and ends that piece in one token."""
        n = self.lib.normalizer.normalize_str(c) if self.lib.normalizer else c
        pieces = [x for _, x in self.lib.pre_tokenizer.pre_tokenize_str(n + n + ".")]
        if pieces != [(0, 2 * len(n)), (2 * len(n), 2 * len(n) + 1)]:
            return False
        ends = self.ends_word[self.lib.encode(c + c, add_special_tokens=False).ids]
        return bool(len(ends)) and int(ends.sum()) == 1 and bool(ends[-1])

    def _unsafe(self, letters: set[str]) -> set[str]:
        """Those of ``letters`` that can be normalised to something other than letters, or aren't letters to the library."""
        for c in letters - self.known:
            if not self._splits(c):
                self.unsafe.add(c)
        self.known |= letters
        return letters & self.unsafe

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of safe letters only, each one piece, encoded as one text and cut after each word's last token."""
        ids = np.array(self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._encode(words)

    def _learn(self, chunks: list[str], stems: list[str]) -> None:
        """Encode new chunks, and new stems that are letters which the library cuts from the signs behind them."""
        stems = [c for c in dict.fromkeys(stems) if c.isalpha()]
        plain = [c for c in chunks if c.isalpha()]
        odd = [c for c in chunks if not c.isalpha()] if len(plain) < len(chunks) else []
        bad = self._unsafe(set("".join(plain)).union(*stems))
        if bad:
            odd += [c for c in plain if not bad.isdisjoint(c)]
            plain, stems = ([c for c in x if bad.isdisjoint(c)] for x in (plain, stems))
        self._keep(odd, *self._encode(odd))
        words = list(dict.fromkeys(plain + stems))
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            self._keep(part, *self._encode_letters(part))
            self.safe[self.count - len(part) : self.count] = True

    def _known(self, chunks: list[str]) -> np.ndarray:
        """Codes of chunks, -1 where a chunk is new."""
        return np.fromiter(map(self.code.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the two pieces of each distinct word: letters and the ASCII signs behind them where the library cuts there, else the whole and -1."""
        stems = pc.utf8_rtrim(words, SIGNS)
        kept = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        signed = (kept > 0) & (kept < pc.binary_length(words).to_numpy(zero_copy_only=False))
        bare, both, stem = (x.filter(pa.array(m)).to_numpy(zero_copy_only=False).tolist() for x, m in ((words, ~signed), (words, signed), (stems, signed)))
        whole, one = self._known(bare), self._known(stem)
        new, unknown = np.flatnonzero(whole < 0).tolist(), np.flatnonzero(one < 0).tolist()
        self._learn([bare[i] for i in new], [stem[i] for i in unknown])
        whole[new], one[unknown] = self._known([bare[i] for i in new]), self._known([stem[i] for i in unknown])
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1)
        first[~signed] = whole
        cut = (one >= 0) & self.safe[one]
        rest = [w[len(c) :] if x else w for w, c, x in zip(both, stem, cut.tolist())]
        self._learn([w for w in dict.fromkeys(rest) if w not in self.code], [])
        two = self._known(rest)
        first[signed], second[signed] = np.where(cut, one, two), np.where(cut, two, -1)
        return first, second

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry than texts). Null is an empty text."""
        arr = as_strings(arr)
        if not self.by_word:
            ids, sizes = self._encode(arr.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        lists = pc.split_pattern(pc.replace_substring(arr, "\n", " "), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        if len(self.code) > MOST_WORDS:
            self._prune()
        first, second = self._codes(words.dictionary)
        two = second >= 0
        pieces = np.stack([first, second], axis=1)
        pieces = pieces[pieces >= 0]
        self.seen[pieces] += 1
        # ids of the distinct words in a row, then of all words
        flat, size = self._gather(pieces)
        begin = np.cumsum(two + 1) - two - 1
        size = np.add.reduceat(size, begin) if len(begin) else size
        at = np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, n = self._gather(index, flat, at, size)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    n = len(ends) - 1
    return np.insert(ids, ends[1:], np.full(n, end_id, np.uint32)).astype(np.uint32), ends + np.arange(n + 1)
