"""Opening a document by ranged reads: only its tail, its cross-reference sections and the objects asked for are fetched.

A backend has `size` and `read_at(offset, n)` (short only at the end). There is no recovery scan: a file without a readable startxref is refused.
"""

from __future__ import annotations

import os
import urllib.request
from bisect import bisect_right
from collections import OrderedDict
from typing import Protocol

from ..kernels.document import Document, DocumentError, Section, classic_section, startxref, stream_section, version
from ..kernels.objects import Parser, ParseError, indirect

CHUNK, CACHE = 64 << 10, 32 << 20
TAILS = (4 << 10, 16 << 10, 64 << 10)


class Backend(Protocol):
    size: int

    def read_at(self, offset: int, n: int) -> bytes: ...


class MemBackend:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]


class FileBackend:
    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY)
        self.size = os.fstat(self.fd).st_size

    def read_at(self, offset: int, n: int) -> bytes:
        out = b""
        while len(out) < n and (got := os.pread(self.fd, n - len(out), offset + len(out))):
            out += got
        return out

    def close(self) -> None:
        os.close(self.fd)


class HttpBackend:
    """A HEAD for the length, then ranged GETs; a server that answers a range with the whole is refused."""

    def __init__(self, url: str, timeout: float = 30):
        self.url, self.timeout = url, timeout
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            n = r.headers.get("Content-Length")
        if n is None:
            raise DocumentError("the server names no length")
        self.size = int(n)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset >= self.size or n <= 0:
            return b""
        q = urllib.request.Request(self.url, headers={"Range": f"bytes={offset}-{min(self.size, offset + n) - 1}"})
        with urllib.request.urlopen(q, timeout=self.timeout) as r:
            if r.status != 206:
                raise DocumentError("ranges are not supported")
            return r.read()


class CachedBackend:
    """Chunks of 64 KiB, the least recently used given up beyond 32 MiB; neighbouring chunks that are missing are read at once."""

    def __init__(self, inner: Backend, chunk: int = CHUNK, most: int = CACHE):
        self.inner, self.chunk, self.most, self.size = inner, chunk, max(1, most // chunk), inner.size
        self.chunks: OrderedDict[int, bytes] = OrderedDict()
        self.fetched = 0

    def read_at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not n:
            return b""
        first, last = offset // self.chunk, (offset + n - 1) // self.chunk
        got, k = {}, first
        while k <= last:
            if k in self.chunks:
                self.chunks.move_to_end(k)
                got[k] = self.chunks[k]
                k += 1
                continue
            end = k
            while end < last and end + 1 not in self.chunks:
                end += 1
            data = self.inner.read_at(k * self.chunk, (end + 1 - k) * self.chunk)
            self.fetched += len(data)
            for j in range(k, end + 1):
                got[j] = self.chunks[j] = data[(j - k) * self.chunk : (j - k + 1) * self.chunk]
            k = end + 1
        while len(self.chunks) > self.most:
            self.chunks.popitem(last=False)
        data = b"".join(got[k] for k in range(first, last + 1))
        return data[offset - first * self.chunk :][:n]


class RangedDocument(Document):
    def __init__(self, backend: Backend, password: str = ""):
        self.backend = backend if isinstance(backend, CachedBackend) else CachedBackend(backend)
        self.version = version(self.backend.read_at(0, 1024))
        self._cache, self._busy, self._stores, self.decryptor, self.data = {}, set(), {}, None, b""
        self._load(password)

    def _load(self, password: str) -> None:
        found = None
        for n in TAILS:
            found = startxref(self.backend.read_at(max(0, self.backend.size - n), n))
            if found:
                break
        if not found:
            raise DocumentError("no startxref in the tail")
        self.sections, seen, todo = [], set(), [found[0]]
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            s = self._section(at)
            self.sections.append(s)
            extra, prev = s.trailer.get("XRefStm"), s.trailer.get("Prev")
            if s.kind == "table" and type(extra) is int and extra not in seen:
                seen.add(extra)
                self.sections.append(self._section(extra))
            if type(prev) is int:
                todo.append(prev)
        self._merge()
        self._offsets = sorted({e.a for e in self.xref.values() if e.kind == "file"} | {s.start for s in self.sections} | {self.backend.size})
        if "Encrypt" in self.trailer:
            self._unlock(password)

    def _section(self, at: int) -> Section:
        n = CHUNK
        while True:
            data = self.backend.read_at(at, n)
            try:
                p = Parser(data).skip()
                s = classic_section(data, p) if data.startswith(b"xref", p) else stream_section(data, p)
                return s._replace(start=s.start + at, end=s.end + at)
            except (ParseError, ValueError, IndexError):
                if at + n >= self.backend.size:
                    raise DocumentError("the cross-reference section can't be read") from None
                n *= 4

    def located(self, num: int):
        e = self.xref.get(num)
        if e is None or e.kind != "file":
            return super().located(num)
        end = self._offsets[min(bisect_right(self._offsets, e.a), len(self._offsets) - 1)]
        ref, x, a, b = indirect(self.backend.read_at(e.a, end - e.a), 0, self.resolve)
        if ref.num != num:
            raise ParseError("another object is there")
        return self._opened(num, ref, x), (a + e.a, b + e.a), None


def open_ranged(spec: str | bytes | Backend, password: str = "") -> RangedDocument:
    """Of a path, an http(s) address, bytes or a backend."""
    if isinstance(spec, bytes):
        spec = MemBackend(spec)
    elif isinstance(spec, str):
        spec = HttpBackend(spec) if spec.startswith(("http://", "https://")) else FileBackend(spec)
    return RangedDocument(spec, password)
