"""Binary files in the shared folder, written and read by tasks.

A task writes under a name that no other attempt uses and returns that name as a row;
only rows of successful attempts reach the manifest, so lost or repeated attempts leave
files that nobody reads.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


#: Schemes of Hadoop's object stores, as the Arrow file systems call them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}


def arrow_uri(uri: str) -> str:
    """A whole URI as Arrow takes it; common.qualified() makes one of a bare path, so that tasks and Spark mean the same place."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{uri} has no scheme: resolve it with common.qualified() first")
    return f"{SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def _at(uri: str):
    return fs.FileSystem.from_uri(arrow_uri(uri))


@contextmanager
def create(folder: str, stem: str, suffix: str):
    """Yields (uri, stream) of a new file in the folder."""
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    with store.open_output_stream(f"{path}/{name}", compression=None) as stream:
        yield f"{folder}/{name}", stream


def open_stream(uri: str):
    store, path = _at(uri)
    return store.open_input_stream(path, compression=None)


def read_bytes(uri: str) -> bytes:
    with open_stream(uri) as stream:
        return stream.read()
