"""Byte-pair weight tables: 65,536 numbers that say how rare a pair is, and their binary form."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lexquarry.functions.hashing import fnv1a

PAIRS, UNSEEN, MOST_PROVENANCE = 65_536, (1 << 32) - 1, 1024
MAGIC = b"SPNG"
_HEADER = struct.Struct("<4sIII")


class TableError(ValueError):
    """A weight table that can't be read."""


class Truncated(TableError):
    pass


class BadMagic(TableError):
    pass


class BadVersion(TableError):
    pass


class BadSize(TableError):
    pass


class BadChecksum(TableError):
    pass


class BadProvenance(TableError):
    pass


@dataclass(frozen=True, eq=False)
class WeightTable:
    weights: np.ndarray = field(repr=False)
    provenance: str | None = None

    def __post_init__(self):
        w = np.ascontiguousarray(self.weights, np.uint32).reshape(PAIRS)
        w.setflags(write=False)
        object.__setattr__(self, "weights", w)

    def __eq__(self, other):
        return isinstance(other, WeightTable) and self.provenance == other.provenance and bool((self.weights == other.weights).all())

    def __hash__(self):
        return self.fingerprint

    @classmethod
    def from_function(cls, f: Callable[[int, int], int]) -> WeightTable:
        return cls(np.array([f(a, b) for a in range(256) for b in range(256)], np.uint32))

    @classmethod
    def synthetic(cls) -> WeightTable:
        """CRC-32 of each pair: a table for tests and for use without a corpus."""
        return cls.from_function(lambda a, b: zlib.crc32(bytes((a, b))))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> WeightTable:
        """total div count, at most 2**32 - 1; pairs that never occur get that."""
        c = np.asarray(counts, np.uint64).reshape(PAIRS)
        total = c.sum(dtype=np.uint64)
        w = np.full(PAIRS, UNSEEN, np.uint64)
        seen = c > 0
        w[seen] = np.minimum(total // c[seen], np.uint64(UNSEEN))
        return cls(w.astype(np.uint32))

    @classmethod
    def from_frame(cls, weights: DataFrame) -> WeightTable:
        """From 65,536 rows (c1, c2, weight); pairs that are missing count as unseen."""
        out = np.full(PAIRS, UNSEEN, np.uint32)
        for r in weights.select("c1", "c2", "weight").collect():
            out[(r["c1"] << 8) | r["c2"]] = r["weight"]
        return cls(out)

    def frame(self, spark: SparkSession) -> DataFrame:
        pdf = pd.DataFrame({"c1": np.arange(PAIRS, dtype=np.int32) >> 8, "c2": np.arange(PAIRS, dtype=np.int32) & 255, "weight": self.weights.astype(np.int64)})
        return spark.createDataFrame(pdf)

    def weight(self, c1: int, c2: int) -> int:
        return int(self.weights[(c1 << 8) | c2])

    def matrix(self) -> np.ndarray:
        return self.weights.reshape(256, 256)

    def with_provenance(self, text: str | None) -> WeightTable:
        if text is not None and len(text.encode()) > MOST_PROVENANCE:
            raise BadProvenance(f"at most {MOST_PROVENANCE} bytes")
        return WeightTable(self.weights, text)

    @property
    def version(self) -> int:
        return 1 if self.provenance is None else 2

    def to_bytes(self) -> bytes:
        body = self.weights.astype("<u4").tobytes()
        if self.provenance is not None:
            text = self.provenance.encode()
            body += struct.pack("<H", len(text)) + text
        return _HEADER.pack(MAGIC, self.version, zlib.crc32(body), 0) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> WeightTable:
        if len(data) < _HEADER.size:
            raise Truncated(len(data))
        magic, version, crc, _ = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise BadMagic(magic)
        body, size, provenance = data[_HEADER.size :], PAIRS * 4, None
        if version == 1:
            if len(body) != size:
                raise BadSize(len(data))
        elif version == 2:
            if len(body) < size + 2:
                raise Truncated(len(data))
            n = struct.unpack_from("<H", body, size)[0]
            text = body[size + 2 :]
            if n > MOST_PROVENANCE or len(text) != n:
                raise BadProvenance(n)
            try:
                provenance = text.decode()
            except UnicodeDecodeError as e:
                raise BadProvenance(str(e)) from e
        else:
            raise BadVersion(version)
        if zlib.crc32(body) != crc:
            raise BadChecksum(crc)
        return cls(np.frombuffer(body[:size], "<u4"), provenance)

    @property
    def fingerprint(self) -> int:
        return fnv1a(self.to_bytes())

    def save(self, path: str) -> None:
        """Written beside its place and moved there."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(self.to_bytes())
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)

    @classmethod
    def load(cls, path: str) -> WeightTable:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())
