"""Files of any store from inside a task, where Hadoop's client is out of reach: through Arrow's file systems."""

from __future__ import annotations

import hashlib
import zipfile
from pathlib import PurePosixPath

#: Schemes of Hadoop's connectors under the names that Arrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}


def filesystem(uri: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/") if colon or uri.startswith("/") else uri
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def write(uri: str, content: bytes) -> None:
    """A file with its folders; names are expected to be new."""
    store, path = filesystem(uri)
    store.create_dir(str(PurePosixPath(path).parent), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(content)


def members(archive: str) -> list[tuple[str, int, bool]]:
    """(name, size, encrypted) of a ZIP's files; only its directory is read."""
    store, path = filesystem(archive)
    with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        return [(i.filename, i.file_size, bool(i.flag_bits & 1)) for i in z.infolist() if not i.is_dir()]


def extract(archive: str, member: str, target: str, most: int) -> tuple[int, str]:
    """Streams a member to a new file; (bytes, SHA-256).  One that holds more than ``most`` bytes is an error, whatever its
    directory says."""
    store, path = filesystem(archive)
    to, place = filesystem(target)
    to.create_dir(str(PurePosixPath(place).parent), recursive=True)
    size, digest = 0, hashlib.sha256()
    with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(member) as src, to.open_output_stream(place) as dst:
        while chunk := src.read(1 << 20):
            size += len(chunk)
            if size > most:
                raise ValueError(f"{member} of {archive} holds more than {most} bytes")
            digest.update(chunk)
            dst.write(chunk)
    return size, digest.hexdigest()
