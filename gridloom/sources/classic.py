"""The header of netCDF classic files (CDF-1, CDF-2 and CDF-5), and where their variables lie."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from .cf import decoded_times

#: Types of the classic format: code to NumPy.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


class Short(ValueError):
    """The bytes end inside the header."""


def as_text(raw: bytes, width: int) -> list[str]:
    return [raw[i : i + width].rstrip(b"\0 ").decode("utf-8", "replace") for i in range(0, len(raw), width)] if width else []


class Header:
    """dims (name to length), attrs, variables (name to dims, attrs, type, begin), records and stride."""

    def __init__(self, raw: bytes):
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a netCDF classic file")
        self.raw, self.version, self.at = raw, raw[3], 4
        self.records = self._count()
        names = [(self._name(), self._count()) for _ in range(self._list(DIMENSION))]
        self.attrs = self._attrs()
        self.variables = {}
        for _ in range(self._list(VARIABLE)):
            name = self._name()
            dims = [names[self._count()][0] for _ in range(self._count())]
            attrs, kind, size = self._attrs(), self._int(), self._count()
            self.variables[name] = {"dims": dims, "attrs": attrs, "type": TYPES[kind], "size": size, "begin": self._int() if self.version == 1 else self._long()}
        record = [n for n, length in names if length == 0]
        self.record = record[0] if record else None
        self.dims = {n: length or self.records for n, length in names}
        grown = [n for n in self.variables if self.grows(n)]
        self.stride = sum(self.variables[n]["size"] for n in grown) if len(grown) != 1 else int(np.prod([self.dims[d] for d in self.variables[grown[0]]["dims"][1:]], dtype=int)) * np.dtype(self.variables[grown[0]]["type"]).itemsize
        del self.raw

    @staticmethod
    def of(read: Callable[[int, int], bytes], first: int = 1 << 16) -> Header:
        """From a function (byte, bytes) that reads a range; the header alone is read, in growing pieces."""
        n = first
        while True:
            raw = read(0, n)
            try:
                return Header(raw)
            except Short:
                if len(raw) < n:
                    raise ValueError("a damaged netCDF header") from None
                n *= 4

    def _need(self, n: int) -> int:
        self.at += n
        if self.at > len(self.raw):
            raise Short
        return self.at - n

    def _int(self) -> int:
        return struct.unpack_from(">i", self.raw, self._need(4))[0]

    def _long(self) -> int:
        return struct.unpack_from(">q", self.raw, self._need(8))[0]

    def _count(self) -> int:
        return self._long() if self.version == 5 else self._int()

    def _bytes(self, n: int) -> bytes:
        at = self._need(n + -n % 4)
        return self.raw[at : at + n]

    def _name(self) -> str:
        return self._bytes(self._count()).decode("utf-8")

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._count()
        if found not in (0, tag):
            raise ValueError("a damaged netCDF header")
        return n

    def _attrs(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTE)):
            name, kind, n = self._name(), TYPES[self._int()], self._count()
            raw = self._bytes(n * np.dtype(kind).itemsize)
            values = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out

    def grows(self, name: str) -> bool:
        """Whether a variable lies in records, one after the other with those of other variables."""
        return self.record is not None and self.variables[name]["dims"][:1] == [self.record]

    def text_dims(self) -> set[str]:
        """Dimensions that count the bytes of texts."""
        return {v["dims"][-1] for v in self.variables.values() if v["type"] == "S1" and v["dims"]}

    def shape(self, name: str) -> list[int]:
        """Without the dimension of the bytes of a text."""
        v = self.variables[name]
        return [self.dims[d] for d in (v["dims"][:-1] if v["type"] == "S1" else v["dims"])]

    def cell_bytes(self, name: str) -> int:
        v = self.variables[name]
        return self.dims[v["dims"][-1]] if v["type"] == "S1" and v["dims"] else np.dtype(v["type"]).itemsize

    def labels(self, dim: str, read: Callable[[int, int], bytes]) -> list:
        """Of the coordinate variable, times decoded; 0, 1, ... without one."""
        v = self.variables.get(dim)
        if v is None:
            return list(range(self.dims[dim]))
        n, size = self.dims[dim], self.cell_bytes(dim)
        raw = b"".join(read(v["begin"] + i * self.stride, size) for i in range(n)) if self.grows(dim) and self.stride != size else read(v["begin"], n * size)
        if v["type"] == "S1":
            return as_text(raw, size)
        out = np.frombuffer(raw, v["type"])
        units = v["attrs"].get("units", "")
        if isinstance(units, str) and " since " in units:
            times = decoded_times(out, units, v["attrs"].get("calendar", "standard"))
            return times if times is not None else out.tolist()
        return out.tolist()

