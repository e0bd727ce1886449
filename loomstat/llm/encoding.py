"""Token ids of many texts at once, and their checksums (task side).

White space always separates tokens in the tokenizers used here, so a text is
the sequence of its white-space-free chunks, and each distinct chunk needs to
be encoded once. Plain words (Latin letters with at most one closing
mark) are reduced to the lower-case word and the mark, and a worker process
remembers the ids of words.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from loomstat.llm.common import strings, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that a worker process may spend on remembered words, and what a word takes besides its characters.
REMEMBERED, ENTRY = 80 << 20, 200
#: New words encoded in one go, and words of one text among them.
GO, LINE = 10_000, 50
TOKENIZER = "word_bpe_49k.json"
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,!?]?)$"
MARKS = [".", ",", "!", "?"]
#: What the vocabulary's entries carry at the end of a word.
WORD_END = "</w>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a lower-casing, space-separated BPE vocabulary file.

    ``path`` is where the executors find the file; by name, it is looked up
    where the task runs.
    """

    def __init__(self, name: str = TOKENIZER, path: str | None = None, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(name))
        entries = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.ends = np.array([bool(e) and e.endswith(WORD_END) for e in entries])
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.first, self.size, self.held = array("I"), array("q"), array("q"), 0
        self._slots(["", *MARKS])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words. They are encoded in lines, and the entries that
        end a word show where each ends; lines where that does not come out
        (words of several parts) are encoded word by word."""
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)]
        sizes, ids = [], []
        for line, got in zip(lines, found):
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(line) or not all(map(str.isalpha, line)):
                each = [e.ids for e in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in each], np.int64))
                ids.append(np.array([i for x in each for i in x], np.int64))
            else:
                sizes.append(np.diff(np.r_[0, stops]))
                ids.append(got)
        return np.concatenate(sizes), np.concatenate(ids)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of words are kept; new words are encoded first."""
        new = [w for w in words if w not in self.at]
        new.sort(key=str.isalpha)  # words of letters share their lines
        for k in range(0, len(new), GO):
            part = new[k : k + GO]
            sizes, ids = self._encode(part)
            begin = len(self.first)
            self.at.update(zip(part, range(begin, begin + len(part))))
            self.first.frombytes((np.cumsum(sizes) - sizes + len(self.flat)).tobytes())
            self.size.frombytes(sizes.tobytes())
            self.flat.frombytes(ids.astype(np.uint32).tobytes())
            self.held += sum(map(len, part)) + ENTRY * len(part)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, end to end, of distinct chunks."""
        parts = pc.extract_regex(distinct.cast(pa.large_string()), PLAIN)
        word, mark = pc.struct_field(parts, "word"), pc.struct_field(parts, "mark")
        coded = pc.if_else(word.is_valid(), pc.utf8_lower(word), distinct.cast(pa.large_string())).dictionary_encode()
        base = self._slots(strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        extra = pc.fill_null(pc.index_in(mark, pa.array(MARKS, pa.large_string())), -1).to_numpy(zero_copy_only=False) + 1
        return self._joined(np.stack([base, self._slots(["", *MARKS])[extra]], axis=1).ravel(), 2)

    def _joined(self, slots: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        sizes, first = (np.frombuffer(x, np.int64)[slots] for x in (self.size, self.first))
        return sizes.reshape(-1, group).sum(axis=1), np.frombuffer(self.flat, np.uint32)[spread(first, sizes)]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, with the end id, and all ids in order. Null counts as empty."""
        counts, index, distinct = words_of(texts)
        if self.held > self.remembered:
            self._forget()
        if not len(index):
            return np.ones(len(counts), np.int64), np.full(len(counts), end, np.uint32)
        each, flat = self._chunks(distinct)
        sizes = each[index]
        ids = flat[spread((np.cumsum(each) - each)[index], sizes)]
        text_ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        return np.diff(np.r_[0, text_ends]) + 1, np.insert(ids, text_ends, np.uint32(end))


def process_encoder(name: str = TOKENIZER, path: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process: tasks that follow each other in one
    process share the words already encoded."""
    memo = sys.modules.setdefault("_encoders_of_process", types.ModuleType("_encoders_of_process")).__dict__
    if (name, path) not in memo:
        memo[name, path] = Encoder(name, path, remembered)
    return memo[name, path]


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``first[i], first[i] + 1, ...`` of each run, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
