"""Rescuing entries of damaged ZIP archives."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

_HEADER = struct.Struct("<4s5H3I2H")


def rescue(data: bytes) -> dict[str, bytes]:
    """Entries found by their local headers, each unpacked by the method that its header names.

    An entry whose data is cut gives what can be unpacked; an entry that can't be read is left out.
    """
    out: dict[str, bytes] = {}
    at = data.find(b"PK\x03\x04")
    while at >= 0 and at + _HEADER.size <= len(data):
        _, _, _, method, _, _, _, packed, _, n_name, n_extra = _HEADER.unpack_from(data, at)
        begin = at + _HEADER.size + n_name + n_extra
        name = data[at + _HEADER.size : at + _HEADER.size + n_name].decode("utf-8", "replace")
        end = begin + packed
        try:
            if method == 8:
                unpacker = zlib.decompressobj(-15)
                body = unpacker.decompress(data[begin:])
                end = len(data) - len(unpacker.unused_data) if unpacker.eof else len(data)
                out[name] = body
            elif method == 0:
                if not packed:
                    following = [x for x in (data.find(s, begin) for s in (b"PK\x07\x08", b"PK\x03\x04", b"PK\x01\x02")) if x >= 0]
                    end = min(following, default=len(data))
                out[name] = data[begin:end]
        except zlib.error:
            end = begin
        at = data.find(b"PK\x03\x04", max(end, at + 4))
    return out


def repaired(data: bytes) -> bytes:
    """The archive itself if it can be read, else a new one of the rescued entries."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if z.testzip() is None:
                return data
    except (zipfile.BadZipFile, zlib.error, struct.error, EOFError):
        pass
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in rescue(data).items():
            if not name.endswith("/"):
                z.writestr(name, body)
    return out.getvalue()
