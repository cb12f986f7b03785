"""Byte sources by path, protocol and extension, for the formats that the driver reads or writes as a stream.

Formats that Spark reads itself take paths as they are: Hadoop's file systems and codecs serve every executor. What is here is for streams
of the driver: standard input, memory, archives, other processes.
"""

from __future__ import annotations

import bz2
import contextlib
import gzip
import io
import subprocess
import sys
import zipfile
from collections.abc import Iterator
from typing import Any
from urllib.request import urlopen

from pyarrow import fs

from ..errors import ArgumentError


class FileSource:
    """A local file."""

    def __init__(self, filename: str, **kwargs: Any):
        self.filename, self.kwargs = filename, kwargs

    def open(self, mode: str = "rb") -> Any:
        return open(self.filename, mode, **self.kwargs)


class GzipSource(FileSource):
    def open(self, mode: str = "rb") -> Any:
        return gzip.open(self.filename, mode, **self.kwargs)


class BZ2Source(FileSource):
    def open(self, mode: str = "rb") -> Any:
        return bz2.open(self.filename, mode, **self.kwargs)


class ZipSource:
    """A member of an archive."""

    def __init__(self, filename: str, membername: str, pwd: bytes | None = None, **kwargs: Any):
        self.filename, self.membername, self.pwd, self.kwargs = filename, membername, pwd, kwargs

    @contextlib.contextmanager
    def open(self, mode: str = "r") -> Iterator[Any]:
        mode = mode.replace("b", "")
        with zipfile.ZipFile(self.filename, "a" if mode == "w" else mode, **self.kwargs) as z, z.open(self.membername, mode, pwd=self.pwd) as f:
            yield f


class StdinSource:
    @contextlib.contextmanager
    def open(self, mode: str = "rb") -> Iterator[Any]:
        if "r" not in mode:
            raise ArgumentError("standard input is read only")
        yield sys.stdin.buffer


class StdoutSource:
    @contextlib.contextmanager
    def open(self, mode: str = "wb") -> Iterator[Any]:
        if "r" in mode:
            raise ArgumentError("standard output is write only")
        yield sys.stdout.buffer
        sys.stdout.buffer.flush()


class URLSource:
    """An http, https or ftp address, read only."""

    def __init__(self, *args: Any, **kwargs: Any):
        self.args, self.kwargs = args, kwargs

    def open(self, mode: str = "rb") -> Any:
        if "r" not in mode:
            raise ArgumentError("an address is read only")
        return urlopen(*self.args, **self.kwargs)  # noqa: S310


class MemorySource:
    """Bytes in memory."""

    def __init__(self, s: bytes | str | None = None):
        self.data = s.encode() if isinstance(s, str) else s or b""

    @contextlib.contextmanager
    def open(self, mode: str = "rb") -> Iterator[Any]:
        if "r" in mode:
            yield io.BytesIO(self.data)
            return
        out = io.BytesIO()
        yield out
        self.data = (self.data if "a" in mode else b"") + out.getvalue()

    def getvalue(self) -> bytes:
        return self.data


StringSource = MemorySource


class PopenSource:
    """The output of a command, given as a list of arguments; a shell is for the caller to ask for."""

    def __init__(self, *args: Any, **kwargs: Any):
        self.args, self.kwargs = args, kwargs

    @contextlib.contextmanager
    def open(self, mode: str = "rb") -> Iterator[Any]:
        if "r" not in mode:
            raise ArgumentError("a command is read only")
        with subprocess.Popen(*self.args, stdout=subprocess.PIPE, **self.kwargs) as p:
            yield p.stdout


class CompressedSource:
    """A codec stacked on another source."""

    def __init__(self, source: Any, codec: type):
        self.source, self.codec = source, codec

    @contextlib.contextmanager
    def open(self, mode: str = "rb") -> Iterator[Any]:
        opener = {GzipSource: gzip.open, BZ2Source: bz2.open}.get(self.codec)
        if opener is None:
            raise ArgumentError(f"no codec {self.codec!r}")
        with self.source.open(mode) as f, opener(f, mode) as g:
            yield g


class RemoteSource:
    """A path of any file system that Arrow knows (file, hdfs, s3, gs, abfs)."""

    def __init__(self, url: str, **kwargs: Any):
        self.url, self.kwargs = url, kwargs

    def open(self, mode: str = "rb") -> Any:
        where, path = fs.FileSystem.from_uri(self.url)
        return where.open_input_stream(path) if "r" in mode else where.open_append_stream(path) if "a" in mode else where.open_output_stream(path)


class SMBSource:
    """An SMB share; needs a client library that isn't a dependency."""

    def __init__(self, url: str, **kwargs: Any):
        self.url = url

    def open(self, mode: str = "rb") -> Any:
        from ..errors import Unavailable

        raise Unavailable("smbclient")


_codecs: dict[str, type] = {".gz": GzipSource, ".bgz": GzipSource, ".bz2": BZ2Source}
_readers: dict[str, type] = {"http": URLSource, "https": URLSource, "ftp": URLSource, "smb": SMBSource}
_writers: dict[str, type] = {"smb": SMBSource}


def register_codec(extension: str, handler: type) -> None:
    _codecs[extension] = handler


def register_reader(protocol: str, handler: type) -> None:
    _readers[protocol] = handler


def register_writer(protocol: str, handler: type) -> None:
    _writers[protocol] = handler


def get_reader(protocol: str) -> type:
    return _readers.get(protocol, RemoteSource)


def get_writer(protocol: str) -> type:
    return _writers.get(protocol, RemoteSource)


def is_stream(source: Any) -> bool:
    """Whether a source is an object of its own and not a path for Spark."""
    return hasattr(source, "open")


def source_of(source: Any, write: bool = False) -> Any:
    """A source object for a path, an address, None (standard input or output), or a source."""
    if source is None:
        return StdoutSource() if write else StdinSource()
    if is_stream(source):
        return source
    protocol, sep, _ = str(source).partition("://")
    if sep and protocol != "file":
        return (get_writer if write else get_reader)(protocol)(source)
    path = str(source).removeprefix("file://")
    for extension, codec in _codecs.items():
        if path.endswith(extension):
            return codec(path)
    return FileSource(path)


def read_bytes(source: Any) -> bytes:
    with source_of(source).open("rb") as f:
        return f.read()


def write_bytes(source: Any, data: bytes, append: bool = False) -> None:
    with source_of(source, True).open("ab" if append else "wb") as f:
        f.write(data)
