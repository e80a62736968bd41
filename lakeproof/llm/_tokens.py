"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct part of a slice once.

Pre-tokens always begin at a single space before a word and at a comma or full stop after a letter or digit, so texts of plain Latin script
are cut there, and the parts' ids joined, unless they hold an added token. Arrow cuts a slice of texts, tells its distinct parts and cuts these into pre-tokens; they go to the
library's model in a few long strings, written in the vocabulary's byte letters and kept apart by the letters of two control characters that such texts don't hold: no merge crosses
a letter that is in no longer token. Nothing is kept from slice to slice. Any other text goes through the library's whole path.
"""

from __future__ import annotations

import functools
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time, and parts in a string that the library gets.
SLICE, CALL = 4 << 20, 512
#: What stands behind each pre-token, and before each part; their byte letters. They are in no longer token, so what stands between them has the same ids as without them.
CUT, MARK = "\0", "\1"
CUT_LETTER, MARK_LETTER = "Ā", "ā"
_PLAIN = r"\A[\n -~À-ÖØ-öø-ɏ]*\z"
_UNSAFE = r"[\n ] (?:[\n ]|\z)|[^0-9A-Za-zÀ-ÖØ-öø-ɏ][.,]"
#: A pre-token of a part; a newline before another character is one of its own, which is seen to first.
_UNIT = r"('s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n+| )"
_LAST_NEWLINE = r"\n([^\n])"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How byte-level vocabularies write each byte: its letter's length in UTF-8, first and last byte. Printable bytes stand for themselves, the others follow at 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    points = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
    written = [chr(points[b]).encode() for b in range(256)]
    return np.array([len(w) for w in written]), np.array([w[0] for w in written], np.uint8), np.array([w[-1] for w in written], np.uint8)


def spelt(data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes in byte letters, as UTF-8, and where each byte's letter begins."""
    length, first, last = (table[data] for table in _letters())
    at = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    out[at] = first
    two = length == 2
    out[at[two] + 1] = last[two]
    return out.tobytes(), at


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() < 1 << 16 else "<u4")
        self.model = Tokenizer(self.whole.model)
        self.cut, self.mark = (self.whole.token_to_id(letter) for letter in (CUT_LETTER, MARK_LETTER))
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        alone = all([token for token in vocabulary if letter in token] == [letter] for letter in (CUT_LETTER, MARK_LETTER))
        shape = repr(self.whole.pre_tokenizer)
        self.by_parts = self.whole.normalizer is None and shape.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in shape and alone
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([_UNSAFE, *added])  # the library takes an added token's string out before it cuts a text

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and n + 1 offsets of the parts into them."""
        if not len(parts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        units = pc.replace_substring_regex(pc.replace_substring_regex(parts, _LAST_NEWLINE, CUT + "\n\\1"), _UNIT, "\\1" + CUT)
        marked = pc.binary_join_element_wise(pa.scalar(MARK, units.type), units, pa.scalar("", units.type)).cast(pa.large_string())
        offsets = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
        letters, at = spelt(np.frombuffer(marked.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]])
        starts = [*at[(offsets[:-1] - offsets[0])[::CALL]].tolist(), len(letters)]
        calls = [letters[a:b].decode() for a, b in zip(starts, starts[1:])]
        told = (self.model.encode_batch_fast([call], add_special_tokens=False)[0] for call in calls)  # one at a time: the library tells much more than ids
        ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in told])
        ids = ids[ids != self.cut]
        begins = np.flatnonzero(ids == self.mark) - np.arange(len(marked))
        return ids[ids != self.mark], np.append(begins, len(ids) - len(marked))

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        marked = texts
        for sign in " ,.":
            marked = pc.replace_substring(marked, sign, CUT + sign)
        lists = pc.split_pattern(marked, CUT)
        coded = lists.flatten().dictionary_encode()
        ids, ends = self._parts(coded.dictionary)
        width = self.dtype.itemsize
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * width), pa.py_buffer(ids)]).take(coded.indices)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(joined) + 1]
        ends = offsets[lists.offsets.to_numpy() - lists.offsets[0].as_py()] // width
        data = joined.buffers()[2]
        ids = np.frombuffer(data, dtype=self.dtype, count=int(ends[-1])) if data is not None and ends[-1] else np.zeros(0, self.dtype)
        ids = ids.copy()  # not the buffer, which is longer
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: pa.Array, lot: int | None = None) -> list[np.ndarray]:
        """The ids of each text, of ``dtype``; a null is empty. Equal parts are encoded once in ``lot`` bytes of text, ``SLICE`` if not given."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        collecting = gc.isenabled()
        gc.disable()  # the many small objects of a slice form no cycles
        try:
            return self._encode(texts, lot or SLICE)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array, lot: int) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = np.zeros(len(texts), bool)
        if self.by_parts:
            plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring_regex(texts, self.unsafe))).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(texts).to_numpy()
        rows = np.flatnonzero(plain)
        lots = np.cumsum(sizes[rows]) // lot
        for one in np.unique(lots):
            some = rows[lots == one]
            for i, ids in zip(some, self._encode_plain(texts.take(pa.array(some)))):
                out[i] = ids
            pa.default_memory_pool().release_unused()
        for i in np.flatnonzero(~plain):
            out[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
        return out


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process."""
    return TextEncoder(path)
