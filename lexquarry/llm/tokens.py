"""Byte-level BPE token ids of whole columns of text. Vocabulary files are read where they lie."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.llm.common import give_back, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STOP = _WHITE.copy()
_STOP[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # lead bytes of other white space


@lru_cache(2)
def _encoding(path: str) -> tuple[tiktoken.Encoding, dict]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {}


def encode(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """All token ids in order (uint16) and each row's offsets; null texts have none.

    No token of this pattern spans the place before a single white-space character that a word follows. Texts are cut there,
    and each distinct piece is encoded once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, raw, data = texts.buffers()
    off = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    if not len(buf):
        return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
    cut = np.zeros(len(buf) + 1, bool)
    cut[:-2] = _WHITE[buf[:-1]] & ~_STOP[buf[1:]] if len(buf) > 1 else False
    cut[off] = True
    bounds = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buf)])
    d = pieces.dictionary_encode()
    encoding, memory = _encoding(path)
    ids = []
    for p in strings(d.dictionary):
        t = memory.get(p)
        if t is None:
            t = encoding.encode_ordinary(p.decode("utf-8", "replace"))
            if len(memory) >= 100_000:
                memory.clear()
            if len(p) < 64:
                memory[p] = t
        ids.append(t)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.fromiter((x for t in ids for x in t), np.uint16, int(start[-1]))
    code = d.indices.to_numpy()
    n = size[code]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(start[:-1][code] - ends[:-1], n) + np.arange(ends[-1])]
    return out, ends[np.searchsorted(bounds, off)]


def count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 of a null one."""

    @F.arrow_udf("int")
    def tokens(t: pa.Array) -> pa.Array:
        sizes = []
        step = 1000
        for i in range(0, len(t), step):
            sizes.append(np.diff(encode(t.slice(i, step), path)[1]))
        give_back()
        return pa.array(np.concatenate(sizes).astype(np.int32) if sizes else np.zeros(0, np.int32))

    return tokens(text.cast("string"))
