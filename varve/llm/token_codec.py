"""Token ids: a byte-level BPE encoder over cached chunks, and Simple-8b word-aligned coding of ids."""

from __future__ import annotations

import re

import numpy as np

from .shared import BoundedCache, worker_cache

#: Entries that each of a worker's three caches holds at most; beyond it the cache starts anew.
CACHE_ENTRIES = 500_000

_BYTE_CHARS: dict[int, int] = {}


def byte_alphabet() -> dict[int, int]:
    """Code points that stand for the 256 bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 up."""
    if not _BYTE_CHARS:
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        _BYTE_CHARS.update({b: b if b in plain else next(spare) for b in range(256)})
    return _BYTE_CHARS


class ChunkEncoder:
    """Encodes texts with the tokenizers library's model as little-endian unsigned 32-bit ids.

    The vocabulary's splitting rule never joins characters across the place before the last space of a white-space
    run, and BPE merges never cross its pieces, so ids of a text are the ids of its chunks in order. Each distinct chunk
    and piece is encoded once while it is cached. Texts that hold an added token's string, or separators on
    which the two regular-expression engines differ, are encoded whole by the library.
    """

    CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    ENDS = frozenset(",.;:!?")

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        split, table, tokenize = regex.compile(public_tokenizers.PATTERN).findall, byte_alphabet(), self.whole.model.tokenize
        coded = [np.array([i], "<u4").tobytes() for i in range(self.whole.get_vocab_size())]
        space = chr(table[32])

        def ids(piece: str) -> bytes:
            word = piece[1:] if piece[0] == " " else piece
            if word.isascii() and word.isalpha():
                letters = space + word if word is not piece else word
            else:
                letters = piece.encode().decode("latin-1").translate(table)
            return b"".join([coded[x.id] for x in tokenize(letters)])

        pieces = BoundedCache(ids, CACHE_ENTRIES)

        def spaced(word: str) -> bytes:  # a word after a space; one piece if it is all letters, two with a sign at its end
            if word.isalpha():
                return ids(" " + word)
            if word[-1:] in self.ENDS and word[:-1].isalpha():
                return self.spaced[word[:-1]] + pieces[word[-1]]
            return b"".join([pieces[p] for p in split(" " + word)])

        self.chunks = BoundedCache(lambda c: b"".join([pieces[p] for p in split(c)]), CACHE_ENTRIES)
        self.spaced = BoundedCache(spaced, CACHE_ENTRIES)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, spaced = self.chunks, self.spaced
        if " ".join(text.split()) == text.replace("\n", " "):  # single spaces and line ends between words, and nothing else
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(chunks[first] + b"".join([spaced[c] for c in rest]))
            return chunks["\n"].join(lines)
        if any(x in text for x in self.ODD):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([chunks[c] for c in self.CHUNK.findall(text)])


def encoder(path: str) -> ChunkEncoder:
    return worker_cache(f"tokens {path}", lambda: ChunkEncoder(path))


#: Simple-8b: values per word and bits per value of selectors 2 to 15. Selector 0 is the escape (the next word is one raw 64-bit value); 1 is unused.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE = 0
#: Ids per block. Each block starts at a word of its own, so any block can be decoded alone.
BLOCK_IDS = 16_384


_SHORT_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < len(_SHORT_BITS):
        return _SHORT_BITS[ids.astype(np.intp)]
    out, rest = np.zeros(len(ids), np.uint8), ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out[big] += step
        rest[big] >>= np.uint64(step)
    return out + (rest > 0).astype(np.uint8)


def _encode_block(ids: np.ndarray) -> np.ndarray:
    n = len(ids)
    widest = {1: np.concatenate([_bit_lengths(ids), np.full(64, 255, np.uint8)])}
    for k in (1, 2, 4, 8, 16):
        a = widest[k]
        widest[2 * k] = np.maximum(a[: len(a) - k], a[k:])
    pick = np.full(n, ESCAPE, np.uint8)
    for sel in range(15, 1, -1):  # from one value a word to sixty: the last that fits holds the most
        count, k = COUNTS[sel - 2], 1 << (COUNTS[sel - 2].bit_length() - 1)
        a = widest[k]
        pick[np.maximum(a[:n], a[count - k : count - k + n]) <= WIDTHS[sel - 2]] = sel
    step = np.ones(16, np.int64)
    step[2:] = COUNTS
    jump, starts, at = step[pick].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts, np.int64)
    sels = pick[starts]
    place = np.cumsum(1 + (sels == ESCAPE)) - 1 - (sels == ESCAPE)
    words = np.zeros(int(place[-1]) + 1 + int(sels[-1] == ESCAPE) if len(starts) else 0, np.uint64)
    for sel in np.unique(sels):
        on = sels == sel
        if sel == ESCAPE:
            words[place[on] + 1] = ids[starts[on]]
            continue
        count, width = COUNTS[sel - 2], WIDTHS[sel - 2]
        values = ids[starts[on][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(width))
        words[place[on]] = np.bitwise_or.reduce(values, axis=1) | np.uint64(int(sel) << 60)
    return words


def simple8b_encode(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the word offset of each block of ids (int32)."""
    ids = np.asarray(ids, np.uint64)
    parts = [_encode_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype(np.int32) if parts else np.zeros(0, np.int32)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def simple8b_decode(words: np.ndarray) -> np.ndarray:
    """All values of whole blocks, selector by selector. An escape's raw word is told from a coded one by its predecessor."""
    words = np.asarray(words, np.uint64)
    sels = (words >> np.uint64(60)).astype(np.int64)
    maybe = np.flatnonzero(sels == ESCAPE)
    raw = np.zeros(len(words) + 1, bool)
    for at in maybe.tolist():  # escapes are rare; in order, since a raw word may itself look like one
        if not raw[at]:
            raw[at + 1] = True
    raw = raw[:-1]
    counts = np.ones(16, np.int64)
    counts[2:] = COUNTS
    counts[ESCAPE] = 0
    size = np.where(raw, 1, counts[sels])
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - size
    out[begin[raw]] = words[raw]
    for sel in np.unique(sels[~raw]):
        if sel == ESCAPE:
            continue
        on = ~raw & (sels == sel)
        count, width = COUNTS[sel - 2], WIDTHS[sel - 2]
        values = (words[on][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
        out[begin[on][:, None] + np.arange(count)] = values
    return out
