"""Files of named flat arrays, memory-mapped by workers.

A file is a magic, the length of a header, the header (JSON: each array's type,
length and place) and the arrays, each at a multiple of 8 bytes. It is written under
another name and renamed when complete, so a repeated or lost task leaves nothing
half-written.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

MAGIC = b"FLATARRS"
_HEAD = struct.Struct("<8sQ")
#: So many files stay open in a worker process.
OPEN = 512


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write the arrays as the file ``name`` in a folder (a URI)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    places, at = {}, 0
    for key, a in arrays.items():
        places[key] = [a.dtype.str, len(a), at]
        at += _padded(a.nbytes)
    header = json.dumps(places).encode()
    header += b" " * (_padded(len(header)) - len(header))
    draft, final = f"{root}/.{name}-{uuid.uuid4().hex}", f"{root}/{name}"
    with fs.open_output_stream(draft) as out:
        out.write(_HEAD.pack(MAGIC, len(header)) + header)
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            out.write(b"\0" * (_padded(a.nbytes) - a.nbytes))
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(draft, final)


def read_arrays(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped where it is a local file and read where it isn't; None if there is no such file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        data = pa.memory_map(path).read_buffer()
    else:
        with fs.open_input_file(path) as f:
            data = f.read_buffer()
    magic, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"{path} holds no arrays")
    places = json.loads(data[_HEAD.size : _HEAD.size + size].to_pybytes())
    return {k: np.frombuffer(data, dtype=d, count=n, offset=_HEAD.size + size + at) for k, (d, n, at) in places.items()}


_OPENED: OrderedDict[tuple[str, str], dict[str, np.ndarray] | None] = OrderedDict()


def mapped(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file that doesn't change; a worker process keeps the last ones mapped."""
    key = (folder, name)
    if key not in _OPENED:
        _OPENED[key] = read_arrays(folder, name)
        if len(_OPENED) > OPEN:
            _OPENED.popitem(last=False)
    _OPENED.move_to_end(key)
    return _OPENED[key]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For wanted keys, their places among sorted keys and whether they are there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), dtype=bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


def small(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the least width that holds all of them."""
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(t).max))
