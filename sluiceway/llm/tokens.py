"""Token ids of whole texts, by a public tokenizer, with a memo of white-space separated chunks."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker remembers (about 130 MB) before it forgets the half that it met last, mostly rare ones.
MEMO_CHUNKS = 700_000
#: Bytes of texts that are split together, and distinct chunks of these from which new words are learnt together, so many at once.
SPLIT_BYTES, MANY_CHUNKS, TOGETHER = 8_000_000, 5000, 20_000
#: Signs that the tokenizer splits off a word.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {32: " "}
_LOADED: dict[str, WordTokens] = {}


class Memo(dict):
    """chunk -> what `learn` says of it, remembered; when full it forgets the half that it met last."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.learn(chunk)
        if len(self) >= MEMO_CHUNKS:
            self.halve()
        self[chunk] = ids
        return ids

    def halve(self) -> None:
        kept = dict(islice(self.items(), MEMO_CHUNKS // 2))
        self.clear()
        self.update(kept)


class WordTokens:
    """A tokenizer whose pre-tokens never cross white space, so a text's ids are those of its chunks in order.

    That holds for tokenizers that split at white space and drop it. Where the tokenizer lower-cases, so
    do the chunks (A-Z only), where it splits a sign off a word, chunks are put together from both, and
    where the model alone gives a word of plain letters its ids, it is asked directly; probes of each show
    whether they hold. A model that marks the last token of a word is asked for many words at once.
    Texts that could hold a special token are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.marks = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.folds = self._whole("ABC Xyz") == self._whole("abc xyz")
        # Signs that stand for themselves as a run of their own, however many follow each other.
        apart = lambda run: self._whole(f"word{run}") == self._whole(f"word {run}")
        self.signs = bytes(c for c in SIGNS if apart(chr(c)) and apart(chr(c) + "!?") and apart("." + chr(c)))
        self.plain = all(self._direct(w.encode()) == self._whole(w) for w in ("a", "word", "zxqvj", "internationally"))
        self.latin = all(self._direct(w.encode()) == self._whole(w) for w in ("été", "über", "größe", "ñandú", "ÀÉ", "µª"))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for token, k in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.memo = Memo(self._learn)

    def _letters(self, word: bytes) -> str:
        """A word, or words with spaces between, as the model reads it: each byte as the letter that stands for it."""
        return word.lower().decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(BYTE_LETTERS)

    def _direct(self, word: bytes) -> bytes:
        """The ids that the model alone gives a word."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(self._letters(word))]).tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        """Remembers the ids of these words, as _direct gives them."""
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            ids = np.array(self.bare.encode_batch_fast([self._letters(b" ".join(part))], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(part):  # the words' tokens can't be told apart, so each is learnt where it is met
                return
            raw, ends = ids.tobytes(), ends.tolist()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _learn_many(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of many distinct chunks: new words are learnt together, and of a word with signs after it only the word is remembered."""
        memo, signs = self.memo, self.signs
        if len(memo) + len(chunks) > MEMO_CHUNKS:
            memo.halve()
        found = list(map(memo.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        cores = [chunks[k].rstrip(signs) for k in new]
        met = set(cores)
        words = set(filter(self._is_word, met))
        fresh = words.difference(memo)
        plain = set(filter(bytes.isascii, fresh))
        for some in plain, fresh - plain:
            self._learn_words(list(islice(some, MEMO_CHUNKS // 2)))
        for k, core in zip(new, cores, strict=True):
            chunk = chunks[k]
            found[k] = memo[core] + memo[chunk[len(core) :]] if core in words and len(core) < len(chunk) else memo[chunk]
        return found

    def _is_word(self, chunk: bytes) -> bool:
        """Whether a chunk is a word whose ids _direct gives: letters of ASCII or, composed, of Latin-1."""
        if chunk.isalpha():
            return self.plain
        if not self.latin or chunk.isascii():
            return False
        text = chunk.decode("utf-8", "surrogatepass")
        return text.isalpha() and max(text) <= "\xff"

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, chunk: bytes) -> bytes:
        """The ids of a chunk: a plain word and the signs after it each by itself, any other by the whole tokenizer."""
        core = chunk.rstrip(self.signs)
        if not core or not self._is_word(core):
            return self._whole(chunk.decode("utf-8", "surrogatepass"))
        return self._direct(chunk) if len(core) == len(chunk) else self.memo[core] + self.memo[chunk[len(core) :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype; none for a null text."""
        out, split, size = [], [], 0
        for text in texts:
            if text and any(m in text for m in self.marks):
                out += [*self._joined(split), self._whole(text)]
                split, size = [], 0
            else:
                raw = (text or "").encode("utf-8", "surrogatepass")
                split.append(raw.lower() if self.folds else raw)
                size += len(raw)
                if size >= SPLIT_BYTES:
                    out += self._joined(split)
                    split, size = [], 0
        return out + self._joined(split)

    def _joined(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text, those of its chunks in order; each distinct chunk is looked up once."""
        # Arrow splits at the six bytes that are white space in ASCII; whether the rest is UTF-8 does not matter.
        cells = pc.ascii_split_whitespace(pa.array(raws, pa.binary()).view(pa.string()))
        coded = cells.flatten().dictionary_encode()
        _, bounds, cut = coded.dictionary.buffers()
        cut, bounds = cut.to_pybytes() if cut else b"", np.frombuffer(bounds, np.int32)[: len(coded.dictionary) + 1].tolist()
        chunks = [cut[low:high] for low, high in zip(bounds, bounds[1:], strict=False)]
        ids = self._learn_many(chunks) if len(chunks) >= MANY_CHUNKS else list(map(self.memo.__getitem__, chunks))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        code = coded.indices.to_numpy()
        held, first = size[code], (np.cumsum(size) - size)[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])
        at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], held)
        raw = np.frombuffer(b"".join(ids), self.dtype)[at].tobytes()
        bounds = (ends[cells.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        return [raw[low:high] for low, high in zip(bounds, bounds[1:], strict=False)]


def forget() -> None:
    """Empties the memos of this worker: its tasks that tokenize share them, those that do other work need the memory."""
    for words in _LOADED.values():
        words.memo.clear()


def load(path: str) -> WordTokens:
    """The tokenizer of this file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
