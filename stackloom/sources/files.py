"""Files by URI from driver or executors, through whichever file system the URI names."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; paths without a scheme are local."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(uri: str) -> NativeFile:
    """A file to seek and read in."""
    system, path = resolve(uri)
    return system.open_input_file(path)


@contextmanager
def written(uri: str, replace: bool = False) -> Iterator[NativeFile]:
    """A stream that becomes the file when the block ends well, so that a lost task leaves no half-written one.

    A file that is there is an error unless ``replace``; tasks that may run again replace what they wrote.
    """
    system, path = resolve(uri)
    if not replace and system.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(uri)
    folder, _, name = path.rpartition("/")
    if folder:
        system.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}" if folder else f"_{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out
        if replace and system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise


def sha256(uri: str, size: int = 1 << 20) -> str:
    """The hash of one file, read in pieces, of any size."""
    h = hashlib.sha256()
    with opened(uri) as f:
        while piece := f.read(size):
            h.update(piece)
    return h.hexdigest()
