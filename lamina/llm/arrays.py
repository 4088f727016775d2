"""Files of sorted arrays in the shared folder, mapped by workers, and compressed blocks of columns for shuffles."""

from __future__ import annotations

import json
import os
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import zstandard

#: Arrays in a file begin at multiples of this.
ALIGN = 64
#: Files that a worker holds mapped, and bytes of files that it holds read where they can't be mapped.
MAPPED, READ = 4096, 256 << 20


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file under a name of its own and move it into place, so a repeated task leaves one whole file."""
    system, inner = _file_system(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    unique = f"{inner}.{os.getpid()}.{os.urandom(6).hex()}"
    table, at = [], 0
    for name, a in arrays.items():
        table.append((name, a.dtype.str, at, len(a)))
        at += -(-a.nbytes // ALIGN) * ALIGN
    head = json.dumps(table).encode()
    head = struct.pack("<q", len(head)) + head
    with system.open_output_stream(unique) as out:
        out.write(head + b"\0" * (-len(head) % ALIGN))
        for a in arrays.values():
            if a.nbytes:
                out.write(memoryview(np.ascontiguousarray(a)).cast("B"))
                out.write(b"\0" * (-a.nbytes % ALIGN))
    try:
        system.move(unique, inner)
    except OSError:  # some file systems don't move onto a file; an earlier attempt's is as good
        system.delete_file(unique)
        if not system.get_file_info(inner).is_file:
            raise


_held: OrderedDict[str, tuple[int, dict[str, np.ndarray]]] = OrderedDict()
_read = 0


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the shared folder is mounted, else read; a worker holds a bounded part of what it read."""
    global _read
    if path in _held:
        _held.move_to_end(path)
        return _held[path][1]
    from pyarrow import fs

    system, inner = _file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        data, size = np.memmap(inner, np.uint8, "r").view(np.ndarray), 0
    else:
        with system.open_input_file(inner) as f:
            data = np.frombuffer(f.read(), np.uint8)
        size = len(data)
    length = int(data[:8].view("<q")[0])
    begin = -(-(8 + length) // ALIGN) * ALIGN
    out = {}
    for name, kind, at, n in json.loads(data[8 : 8 + length].tobytes()):
        kind = np.dtype(kind)
        out[name] = data[begin + at : begin + at + n * kind.itemsize].view(kind)
    _held[path] = (size, out)
    _read += size
    while len(_held) > MAPPED or (_read > READ and len(_held) > 1):
        _read -= _held.popitem(last=False)[1][0]
    return out


def narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and whole numbers of 64 bits apart for those that don't fit."""
    small = np.minimum(values, 255).astype(np.uint8)
    at = np.flatnonzero(small == 255)
    return {name: small, f"{name}_at": at.astype(np.uint32), f"{name}_of": values[at].astype(np.int64)}


def widen(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """What ``narrow`` was given, at some places."""
    out = arrays[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = arrays[f"{name}_of"][np.searchsorted(arrays[f"{name}_at"], at[big].astype(np.uint32))]
    return out


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Compressed bytes of columns of integers that are not negative; the first is sorted and goes by its steps."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes, kinds = [], ""
    for c in columns:
        kind = np.min_scalar_type(int(c.max())) if len(c) else np.dtype("u1")
        kinds += kind.char
        planes.append(np.ascontiguousarray(c.astype(kind, copy=False).view(np.uint8).reshape(-1, kind.itemsize).T))
    head = struct.pack("<qB", len(columns[0]), len(kinds)) + kinds.encode()
    return head + zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    n, width = struct.unpack_from("<qB", data)
    kinds = [np.dtype(c) for c in data[9 : 9 + width].decode()]
    flat = np.frombuffer(zstandard.decompress(data[9 + width :]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        out.append(np.ascontiguousarray(flat[at : at + n * kind.itemsize].reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += n * kind.itemsize
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def by_value(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Every value of a sorted array with its range."""
    edges = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    starts = np.concatenate(([0], edges, [len(sorted_values)])).astype(np.int64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b > a:
            yield int(sorted_values[a]), slice(a, b)
