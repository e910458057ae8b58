"""Token ids of whole texts through the ``tokenizers`` library, each distinct word encoded once.

Running the library over every occurrence of every word costs far more than the words are worth:
its merges take microseconds a word.  Texts are therefore cut where the vocabulary's own rules
always cut, the distinct pieces of a batch are found by Arrow, and only pieces not seen before go
through the library, letters and punctuation apart.  Texts in which those cuts could matter (adjacent white space, the separator
itself) are encoded whole.  Seen pieces stay in the worker up to a fixed number of
bytes.  A text is encoded at once, so a worker needs memory for its longest one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leakframe.llm.memory import give_back, hold, trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CUT = "\x01"
# two white-space characters in a row, or the separator: such texts are encoded whole
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
IRREGULAR = rf"[{_SPACE}][{_SPACE}]|\x01"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # ASCII without the apostrophe, which begins contractions
PLAIN = {mode: rf"^(?P<word>{lead}[{_LETTERS}]+)(?P<tail>[{_PUNCTUATION}]*)\z" for mode, lead in (("word", ""), ("byte", " "))}
REMEMBERED_BYTES = 24 << 20  # of pieces and words together, with what Python adds to each
ENTRY_BYTES = 200
PART_BYTES = 1 << 20


def _strings(found: pa.Array) -> list[str]:
    """As ``to_pylist()``, many times as fast."""
    return found.to_numpy(zero_copy_only=False).tolist()


def _gathered(pool: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` (they are ``lengths`` long) that ``index`` names, and the length of each."""
    sizes = lengths[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    place = np.int32 if total < 1 << 31 and len(pool) < 1 << 31 else np.int64
    begins = (np.cumsum(lengths) - lengths)[index]
    return pool[np.repeat((begins - ends + sizes).astype(place), sizes) + np.arange(total, dtype=place)], sizes


class Encoder:
    """Ids as unsigned 32-bit integers.  ``mode`` is found from the vocabulary file: ``word``
    drops white space and marks word ends, ``byte`` keeps a space with the word after it, and
    ``whole`` (any other file) takes no short cut."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        vocabulary = rules["model"]["vocab"]
        marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        splitter = rules.get("pre_tokenizer") or {}
        if rules["model"].get("end_of_word_suffix") == "</w>" and "normalizer" in rules:
            self.mode = "word"
            marked = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        elif splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not rules.get("normalizer"):
            self.mode = "byte"
            marked = [i for token, i in vocabulary.items() if token.startswith("Ġ")]
        else:
            self.mode, marked = "whole", []
        marks[marked] = True
        self.joiner = self.tokenizer
        if self.mode == "word":  # lower-cased letters and single spaces need no rules but these
            self.joiner = Tokenizer(self.tokenizer.model)
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.joiner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.marks, self.remembered = marks, remembered
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of letters in one call: the vocabulary marks where each word ends or begins."""
        text = " ".join(words) if self.mode == "word" else "".join(words)
        ids = np.array(self.joiner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(words):
            return self._library(words)
        edges = np.concatenate([[0], at + 1]) if self.mode == "word" else np.append(at, len(ids))
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _known(self, memory: dict[str, bytes], found: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct strings.  What is new goes through the library once and is remembered
        while there is room: frequent strings come early."""
        values = list(map(memory.get, found))
        new = [k for k, value in enumerate(values) if value is None]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            texts = [found[k] for k in part]
            coded = encode(texts)
            for k, value in zip(part, coded):
                values[k] = value
            self._remember(memory, zip(texts, coded))
        return values

    def _values(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and the number of ids of each.  A piece of
        letters and punctuation is told by its word and its tail, so that a word in another case or
        before another comma is not a new one."""
        split = pc.extract_regex(found, PLAIN[self.mode])
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        words, tails = split.drop_null().flatten()
        words = (pc.utf8_lower(words) if self.mode == "word" else words).dictionary_encode()
        tails = tails.dictionary_encode()
        # units: nothing, the words, their tails, other pieces; a piece is two of them
        values = [b"", *self._known(self.words, _strings(words.dictionary), self._joined)]
        after_words = len(values)
        values += self._known(self.pieces, _strings(tails.dictionary), self._library)
        after_tails = len(values)
        values += self._known(self.pieces, _strings(found.filter(pa.array(~plain))), self._library)
        units = np.zeros((len(found), 2), np.int64)
        units[plain, 0] = words.indices.to_numpy() + np.int64(1)
        units[plain, 1] = tails.indices.to_numpy() + np.int64(after_words)
        units[~plain, 0] = np.arange(after_tails, len(values))
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool, sizes = _gathered(np.frombuffer(b"".join(values), "<u4"), lengths, units.reshape(-1))
        return pool, sizes.reshape(-1, 2).sum(1)

    def _remember(self, memory: dict[str, bytes], entries: Iterable[tuple[str, bytes]]) -> None:
        """Entries while there is room.  Very long pieces are rare and would fill it."""
        for piece, ids in entries:
            size = ENTRY_BYTES + 4 * len(piece) + len(ids)
            if self.held + size > self.remembered:
                return
            if size < 4 * ENTRY_BYTES:
                memory[piece] = ids
                self.held += size

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows ``begin`` to ``end`` at a time, with their ids and counts: about ``PART_BYTES`` of
        text, so that what is in memory does not depend on the size of a batch.  What a part took is
        given back before the next one: kept in pieces by the C library, it would add up."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
            yield (begin, end, *self.encode(texts.slice(begin, end - begin)))
            begin = end
            trim()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text.  A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.mode == "whole":
            found = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        whole = np.zeros(len(texts), bool)
        if self.mode == "byte":
            whole = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        regular = texts if not whole.any() else pc.if_else(pa.array(whole), "", texts)
        if self.mode == "word":
            parts = pc.split_pattern(pc.replace_substring(regular, "\n", " "), " ")
        else:
            marked = pc.replace_substring(pc.replace_substring(regular, " ", CUT + " "), "\n", CUT + "\n")
            parts = pc.split_pattern(marked, CUT)
        counts = pc.list_value_length(parts).to_numpy()
        coded = parts.flatten().dictionary_encode()
        ids, sizes = _gathered(*self._values(coded.dictionary), coded.indices.to_numpy())
        ends = np.cumsum(sizes)
        edges = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], ends])[edges]
        n = np.diff(bounds)
        if whole.any():
            out, rows = [], np.flatnonzero(whole).tolist()
            exact = dict(zip(rows, self._library([texts[r].as_py() for r in rows])))
            for r in range(len(texts)):
                one = np.frombuffer(exact[r], "<u4") if r in exact else ids[bounds[r]:bounds[r + 1]]
                out.append(one)
                n[r] = len(one)
            ids = np.concatenate(out)
        return ids, n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    hold("tokens", _ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        give_back()  # the file and its rules, as read
    return _ENCODERS[path]
