"""Token ids of texts, as the tokenizers library gives them for a vocabulary file.

A byte-level vocabulary whose merges stand in the order of their ids gives the same ids by its ranks
alone. ``ByteEncoder`` checks that of the file and then asks tiktoken, which keeps neither offsets nor
token strings and is several times faster; texts that name an added token go to the tokenizers library.

A vocabulary with word ends drops the space of ``x y`` (one space between two characters that are no
white space) before it merges. So ``WordEncoder`` cuts a text there, encodes each distinct piece once by
the tokenizers library, and joins the ids. Where a space stands next to other white space the text isn't
cut. Encoded pieces are kept up to a bound.

Edge cases: a null text is empty and has no ids; a text may be one word or one run of white space of any
length; repeated texts are each answered.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_BESIDE = re.compile(r"\s(?:\s|\Z)").search
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters for the mark between pieces; the first that is a single id is used.
_MARKS = "§¶±~^"
#: Letters that are one word whatever stands beside them, with a stop or comma that is a word of its own.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?\Z").match
#: Fixed value: how byte-level vocabularies cut a text before the merges.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[tuple, object] = {}


def loose(text: str) -> bool:
    """Whether white space stands beside white space, or at an end: then not every space is a place to cut."""
    return text[:1].isspace() or _BESIDE(text) is not None


def library(path: str):
    """The tokenizers library's own encoder of a vocabulary file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """(rank of each byte string, added tokens) of a vocabulary that is fully told by ranks; None for any other."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges")):
        return None
    added = [t["content"] for t in spec.get("added_tokens", [])]
    vocabulary, of = {t: i for t, i in model["vocab"].items() if t not in added}, _byte_characters()
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if sorted(vocabulary.values()) != list(range(256 + len(merges))) or any(vocabulary.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(map(of.__getitem__, t)): i for t, i in vocabulary.items()}, added


class ByteEncoder:
    """Ids as little-endian bytes, two or four an id (``dtype`` <u2 or <u4, on little-endian machines)."""

    def __init__(self, path: str, dtype: str, ranks: dict[bytes, int], added: list[str]):
        import tiktoken

        self.path, self.code, self.added, self.tokenizer = path, {"<u2": "H", "<u4": "I"}[dtype], added, None
        self.ids = tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        out, code, ids = [], self.code, self.ids
        for t in texts:
            if any(a in t for a in self.added):
                self.tokenizer = self.tokenizer or library(self.path)
                out.append(array(code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(array(code, ids(t)).tobytes())
        return out


class WordEncoder:
    """Ids as bytes of ``dtype`` (<u2 or <u4, on little-endian machines).

    New pieces go to the library as one text: letters alone (a stop or comma after them is a word of its
    own) side by side, as each ends with the vocabulary's word end; other pieces with a mark between them
    that is a single id and occurs in none. ``held`` bounds the number of pieces kept: half of them
    new or met again since the other half was put aside.
    """

    def __init__(self, path: str, dtype: str, held: int = 900_000):
        self.tokenizer = library(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are kept here
        self.dtype, self.half = dtype, held // 2
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.plain = _PLAIN if self.ending[self._ids("word a .")].sum() == 3 else (lambda _: None)
        self.stops = {x: self._ids(x).tobytes() for x in ".,"}
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        ids = [self._ids(f"a {m} b").tolist() for m in _MARKS]
        self.mark, self.mark_id = next(((m, x[1]) for m, x in zip(_MARKS, ids, strict=True) if len(x) == 3), ("", -1))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def learn(self, pieces: set[str]) -> None:
        """Makes sure that ``known`` holds the ids of each piece; a space stands before each but the first of a text."""
        if len(self.known) > self.half:
            self.known, self.aside = {}, self.known
        fresh = self._again(pieces)
        plain = {x for x in fresh if self.plain(x)}
        stopped = [x for x in plain if x[-1] in ".,"]
        letters = list((plain.difference(stopped)) | self._again({x[:-1] for x in stopped}))
        others = list(fresh - plain)
        for group in (letters[i : i + 1000] for i in range(0, len(letters), 1000)):
            ids = self._ids(" ".join(group))
            self._keep(group, ids, np.concatenate([[0], np.flatnonzero(self.ending[ids]) + 1]))
        bound = {x for x in others if not self.mark or self.mark in x or "<|" in x}
        marked = [x for x in others if x not in bound]
        for group in (marked[i : i + 1000] for i in range(0, len(marked), 1000)):
            between = f" {self.mark} "
            ids = self._ids(between + between.join(group) + between)
            at = np.flatnonzero(ids == self.mark_id)
            self._keep(group, ids, at + 1, at[1:])
        alone = list(bound)
        for x, e in zip(alone, self.tokenizer.encode_batch_fast([" " + x for x in alone], add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, self.dtype).tobytes()
        self.known.update((x, self.known[x[:-1]] + self.stops[x[-1]]) for x in stopped)

    def _keep(self, group: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray | None = None) -> None:
        raw, size = ids.tobytes(), ids.itemsize
        ends = begins[1:] if ends is None else ends
        self.known.update((x, raw[a:b]) for x, a, b in zip(group, (begins[:-1] * size).tolist(), (ends * size).tolist(), strict=True))

    def _again(self, pieces: set[str]) -> set[str]:
        """The pieces that are new; those that were put aside are taken back."""
        fresh = pieces.difference(self.known)
        back = [x for x in fresh if x in self.aside]
        self.known.update((x, self.aside[x]) for x in back)
        fresh.difference_update(back)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if loose(t) else t.split(" ") for t in texts]
        later: set[str] = set()
        for parts in cut:
            later.update(parts[1:])
        self.learn(later)
        heads = [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([p[0] for p in cut], add_special_tokens=False)]
        get = self.known.__getitem__
        return [head + b"".join(map(get, p[1:])) for head, p in zip(heads, cut, strict=True)]


class LibraryEncoder:
    """Ids by the tokenizers library on whole texts, for any other vocabulary."""

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = library(path), dtype

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str, dtype: str):
    """The encoder of this Python worker for a vocabulary; it is reused by later tasks."""
    if (path, dtype) not in _ENCODERS:
        ranks = byte_ranks(path)
        _ENCODERS[path, dtype] = ByteEncoder(path, dtype, *ranks) if ranks else LibraryEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def portions(lengths: list[int], most: int):
    """Slices of consecutive items of about ``most`` in sum; an item alone may be more."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def encode_series(texts, path: str, dtype: str, most: int = 2_000_000):
    """The ids of each text of a list that may hold nulls (empty), in portions of bounded memory."""
    texts = [t or "" for t in texts]
    held = encoder(path, dtype)
    for part in portions([len(t) for t in texts], most):
        yield from held.encode(texts[part])
