"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last 32 bytes hits a mask, so documents that share a passage
share its chunks wherever the passage stands. A worker encodes each distinct chunk once and keeps it, up
to a bound, over all its tasks. A cut may fall inside a word, so a chunk's first and last words stay
open, and each join of two chunks is repaired: the open words are joined and encoded by the library
together with a word on either side; if the ids begin and end with those that the outer words have in
their chunks, they close the join, and if not, the window takes twice as many words, up to the whole
text. Repaired joins are kept like chunks. A chunk of fewer than four words is merged with the next.
Decoding gives what the library's ``decode(ids, skip_special_tokens=False)`` gives for a vocabulary
without a decoder: the tokens, joined by spaces.

Edge cases: null and empty texts have no ids and decode to the empty text; repeated rows are each
returned; a text without a cut or without words is a single chunk, however long; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _CUT, WordEncoder, loose, portions

WINDOW, MASK_BITS, LEAST = 32, 9, 64
#: Characters of chunks, and number of joins, that a worker keeps: half of them since it put the others aside.
HELD, JOINS = 24_000_000, 100_000
_GEAR = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))


def cut_points(data: bytes) -> list[int]:
    """Where a UTF-8 text is cut: after a hit of the rolling hash, ``LEAST`` bytes apart, before a character and beside no space."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # h[i] sums gear[b[i-j]] << j over the window, by doubling
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    cuts, last, at, end = [], 0, 0, len(data)
    for i in (np.flatnonzero((h & _MASK) == 0) + 1).tolist():
        if i <= at:
            continue
        while i < end and (data[i] & 0xC0 == 0x80 or data[i] == 0x20 or data[i - 1] == 0x20):
            i += 1
        at = i
        if i - last >= LEAST and i < end:
            cuts.append(i)
            last = i
    return cuts


def chunks(text: str) -> list[tuple[str, bool]]:
    """The chunks of a text, in order, each with four words or more unless it is alone; and whether its text is loose.

    No chunk begins or ends beside a space, so one of a text that isn't loose has its words between single spaces.
    """
    data = text if text.isascii() else text.encode("utf-8", "replace")
    raw = data.encode() if isinstance(data, str) else data
    is_loose = loose(text)
    out, begin = [], 0
    for end in (*cut_points(raw), len(raw)):
        chunk = data[begin:end]
        if isinstance(chunk, bytes):
            chunk = chunk.decode("utf-8")
        if chunk.count(" ") >= 3 and (not is_loose or len(_CUT.split(chunk)) >= 4):
            out.append((chunk, is_loose))
            begin = end
    if begin < len(raw) or not out:
        rest = data[begin:]
        out = [*out[:-1], ((out[-1][0] if out else "") + (rest.decode("utf-8") if isinstance(rest, bytes) else rest), is_loose)]
    return out


class Store:
    """A dictionary in two halves: when the newer one is full, the older one is forgotten, but for what is asked again."""

    def __init__(self, most: int):
        self.new, self.old, self.half, self.size = {}, {}, most // 2, 0

    def missing(self, keys: set) -> list:
        """The keys that have to be put in; the others are in ``new`` from now on."""
        if self.size > self.half:
            self.new, self.old, self.size = {}, self.new, 0
        fresh = []
        for key in keys.difference(self.new):
            if key in self.old:
                self.put(key, self.old[key])
            else:
                fresh.append(key)
        return fresh

    def put(self, key, value) -> None:
        self.new[key] = value
        self.size += len(key[0]) if isinstance(key[0], str) else 1


def _between(ids: bytes, before: bytes, after: bytes) -> bytes | None:
    """What is left of a window's ids if they begin and end with those of its outer words, else None."""
    agreed = len(ids) >= len(before) + len(after) and ids.startswith(before) and ids.endswith(after)
    return ids[len(before) : len(ids) - len(after)] if agreed else None


class ChunkEncoder:
    def __init__(self, path: str):
        self.words = WordEncoder(path, "<u4")
        tokenizer = self.words.tokenizer
        self.tokens = [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known, self.joins = Store(HELD), Store(JOINS)
        self.encoded = self.repaired = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[tuple[str, bool]]) -> None:
        """Of each chunk: the ids of the words between its open ones; its first two words; its last two; the ids of the inner word at either end."""
        cut = [_CUT.split(text) if is_loose else text.split(" ") for text, is_loose in new]
        inner: set[str] = set()
        for words in cut:
            inner.update(words[1:-1])
        self.words.learn(inner)
        get = self.words.known.__getitem__
        for c, words in zip(new, cut, strict=True):
            ids = list(map(get, words[1:-1]))
            self.known.put(c, (b"".join(ids), words[:2], words[-2:], *(ids[:1] or [b""]), *(ids[-1:] or [b""])))
        self.encoded += len(new)

    def _repair(self, pairs: list[tuple]) -> None:
        """The ids of the open words at the join of two chunks."""
        known = self.known.new
        self.repaired += len(pairs)
        windows = []
        for a, b in pairs:
            left, right = known[a][2], known[b][1]
            windows.append(f"{left[0]} {left[1]}{right[0]} {right[1]}")
        for (a, b), ids in zip(pairs, self._library(windows), strict=True):
            closed = _between(ids, known[a][4], known[b][3])
            self.joins.put((a, b), self._widened(a, b) if closed is None else closed)

    def _widened(self, a: tuple, b: tuple, words: int = 2) -> bytes | None:
        """The ids at a join by a window of more words on each side, twice as many each time; None if no window agrees."""
        left, right = _CUT.split(a[0]), _CUT.split(b[0])
        closed = None
        while closed is None and words <= min(len(left), len(right)) - 2:
            before, after = self.words.encode([" " + " ".join(left[-1 - words : -1]), " " + " ".join(right[1 : 1 + words])])
            closed = _between(*self._library([" ".join(left[-1 - words :]) + " ".join(right[: 1 + words])]), before, after)
            words *= 2
        return closed

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [chunks(t) for t in texts]
        self._learn(self.known.missing({c for cs in cut for c in cs}))
        self._repair(self.joins.missing({p for cs in cut for p in zip(cs, cs[1:], strict=False)}))
        known, joins = self.known.new, self.joins.new
        # the open words at both ends of each text
        firsts, lasts = [known[cs[0]][1] for cs in cut], [known[cs[-1]][2] for cs in cut]
        heads = self._library([words[0] for words in firsts])
        tails = self._library([" " + words[-1] if len(cs) > 1 or len(words) > 1 else "" for cs, words in zip(cut, lasts, strict=True)])
        out, apart = [], []
        for i, (cs, head, tail) in enumerate(zip(cut, heads, tails, strict=True)):
            ids = [head, known[cs[0]][0]]
            for pair in zip(cs, cs[1:], strict=False):
                ids += [joins[pair], known[pair[1]][0]]
            if None in ids:
                apart.append(i)
                ids = []
            out.append(b"".join([*ids, tail]))
        for i, ids in zip(apart, self._library([texts[i] for i in apart]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encode_documents(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: ids as little-endian unsigned 32-bit numbers, decoded as text.

    No shuffle; a task holds its kept chunks and one portion of texts.
    """

    def each(batches):
        held = _ENCODERS.get(tokenizer) or ChunkEncoder(tokenizer)
        _ENCODERS[tokenizer] = held
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for part in portions([len(t) for t in texts], 1_000_000):
                ids = held.encode(texts[part])
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")[part], "ids": ids, "decoded": [held.decode(x).decode() for x in ids]})

    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, "doc_id long, ids binary, decoded string")
