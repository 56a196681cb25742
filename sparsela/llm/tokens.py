"""Byte-level BPE over whole texts: token ids (packing) and token counts.

A text is cut where a white-space run begins after a character that is certainly not white
space. No pre-token of the byte-level pattern crosses such a place, so the chunks encode
independently, and each distinct chunk of a batch is encoded once.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import regex

from .text import _IS_WS, binaries, pybytes, raw

CACHE_ENTRIES = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Vocabulary strings as bytes, without added tokens."""
    t = _library(path)
    byte = {c: b for b, c in _byte_chars().items()}
    added = {a.content for a in t.get_added_tokens_decoder().values()}
    return {bytes(byte[c] for c in s): i for s, i in t.get_vocab().items() if s not in added}


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(4)
def _merger(path: str):
    """tiktoken over the strings that merges reach: their ids are ranks of merges, as in the .json."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={s: vocabulary(path)[s] for s in whole_tokens(path)}, special_tokens={})


@functools.lru_cache(4)
def whole_tokens(path: str) -> frozenset[bytes]:
    """Proof by trial, once for a vocabulary: the strings that merge to themselves alone.

    The trial is the library's own model without pre-tokenizer, which merges from single bytes;
    tiktoken looks a whole piece up first, so it can't tell. Other strings never come out of merges,
    and the merger leaves them out. A byte string's merges depend on nothing but the string, so a
    pre-token equal to one of these is one token wherever it stands."""
    model = _library(path).model
    chars = _byte_chars()
    alone = lambda s: [t.id for t in model.tokenize("".join(map(chars.get, s)))]
    return frozenset(s for s, i in vocabulary(path).items() if alone(s) == [i])


@functools.lru_cache(1)
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


#: Characters for which all libraries agree on the classes of the pattern.
_PLAIN = regex.compile(rb"[\x00-\x1b\x20-\x7e]*").fullmatch
_LATIN = regex.compile(r"[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]*").fullmatch


def chunks(col: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Chunk codes, distinct chunks, chunk offsets per text, byte lengths of the texts."""
    data, offs = raw(col)
    n = len(data)
    if not n:
        return np.empty(0, np.int64), [], np.zeros(len(offs), np.int64), np.diff(offs)
    ws = _IS_WS[data]
    cut = np.zeros(n, bool)
    solid = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    solid[1:] |= (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    cut[1:] = ws[1:] & solid
    cut[offs[:-1][offs[:-1] < n]] = True
    start = np.flatnonzero(cut)
    d = binaries(data, np.append(start, n)).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), pybytes(d.dictionary), np.searchsorted(start, offs), np.diff(offs)


_IDS: dict[str, dict[bytes, tuple[int, ...]]] = {}

_MARKS = frozenset(b".,;:!?")


def _simple(c: bytes) -> tuple[bytes, bytes] | None:
    """A chunk of Latin letters, after one blank at most and before one mark at most, is one
    pre-token, and the mark another; None for other chunks."""
    mark = c[-1] in _MARKS
    body = c[c[0] == 32 : len(c) - mark]
    if body.isalpha() or not body.isascii() and (s := body.decode()).isalpha() and max(s) <= "\u017f":
        return (c[:-1], c[-1:]) if mark else (c, b"")
    return None


def _encode(path: str, c: bytes):
    """Ids of a chunk as the tokenizers library gives them, its special strings included."""
    if m := _simple(c):
        piece = _merger(path)._core_bpe.encode_single_piece
        return piece(m[0]) + piece(m[1]) if m[1] else piece(m[0])
    if b"<|" not in c and (_PLAIN(c) or _LATIN(c.decode())):
        return _merger(path).encode_ordinary(c.decode())
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _library(path).encode(c.decode(), add_special_tokens=False).ids


def encode(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids (uint32) of all texts in one array, and offsets per text."""
    codes, uniq, coff, _ = chunks(col)
    known = _IDS.setdefault(path, {})
    if len(known) > CACHE_ENTRIES:
        known.clear()
    get, got = known.get, []
    for c in uniq:
        ids = get(c)
        if ids is None:
            ids = known[c] = tuple(_encode(path, c))
        got.append(ids)
    lens = np.fromiter(map(len, got), np.int64, len(got))
    flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lens.sum()))
    first = np.cumsum(lens) - lens
    if not len(codes):
        return np.empty(0, np.uint32), np.zeros(len(coff), np.int64)
    clen = lens[codes]
    end = np.concatenate(([0], np.cumsum(clen)))
    out = np.empty(int(end[-1]), np.uint32)
    step = 1 << 20  # chunks at once: bounds the index arrays
    for a in range(0, len(codes), step):
        b = min(a + step, len(codes))
        k, m = codes[a:b], clen[a:b]
        out[end[a] : end[b]] = flat[np.arange(end[b] - end[a]) + np.repeat(first[k] - (end[a:b] - end[a]), m)]
    return out, end[coff]


_COUNTS: dict[str, dict[bytes, int]] = {}


def _count(path: str, c: bytes, whole: frozenset[bytes]) -> int:
    piece = _merger(path)._core_bpe.encode_single_piece
    if m := _simple(c):
        parts = m
    elif b"<|" not in c and (_PLAIN(c) or _LATIN(c.decode())):
        parts = [p.encode() for p in _pattern().findall(c.decode())]
    else:
        return len(_encode(path, c))
    return sum(1 if p in whole else len(piece(p)) for p in parts if p)


def count(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and bytes of each text. Pre-tokens that are whole tokens count one; only the rest is merged."""
    codes, uniq, coff, nbytes = chunks(col)
    whole, known = whole_tokens(path), _COUNTS.setdefault(path, {})
    if len(known) > CACHE_ENTRIES:
        known.clear()
    num = []
    for c in uniq:
        m = known.get(c)
        if m is None:
            m = known[c] = _count(path, c, whole)
        num.append(m)
    total = np.concatenate(([0], np.cumsum(np.array(num, np.int64)[codes]))) if len(codes) else np.zeros(1, np.int64)
    return np.diff(total[coff]), nbytes
