"""Bytes on shared storage from inside tasks: new files and range reads, by any URI that Arrow opens."""

from __future__ import annotations

from pyarrow import fs


def open_new(uri: str):
    """A stream to a new file; its folder is made."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def read_all(uri: str) -> bytes:
    """A whole file."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


class Ranges:
    """read(uri, offset, length), keeping the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            store, path = fs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, store.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
