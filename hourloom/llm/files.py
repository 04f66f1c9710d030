"""Files of the shared folder, as Python workers see them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs, parquet


def create(uri: str):
    """Output stream to a new file; folders are made as needed."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def stream(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def seekable(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def chunks(uri: str, size: int = 1 << 20) -> Iterator[bytes]:
    with stream(uri) as f:
        while part := f.read(size):
            yield part


def rows_in(uri: str) -> Iterator[pa.Table]:
    """The tables of one folder of a partitioned Parquet table; none where there is no such folder."""
    system, path = fs.FileSystem.from_uri(uri)
    for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield parquet.ParquetFile(f).read()
