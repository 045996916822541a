"""Single files out of zip archives, whole or damaged."""

from __future__ import annotations

import shutil
import struct
import zipfile
import zlib
from pathlib import Path

#: Fixed values of the zip format: the local header's signature and its methods.
LOCAL_HEADER = b"PK\x03\x04"
STORED, DEFLATED = 0, 8
CHUNK = 1 << 20


def extract_single(archive: str | Path, folder: str | Path, suffix: str = ".dta") -> Path:
    """The one member with ``suffix``, extracted unless a whole copy is there already; a damaged archive is recovered."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    try:
        with zipfile.ZipFile(archive) as z:
            members = [m for m in z.infolist() if m.filename.lower().endswith(suffix)]
            if len(members) != 1:
                raise ValueError(f"{archive}: {len(members)} members end in {suffix}")
            out = folder / Path(members[0].filename).name
            if not (out.exists() and out.stat().st_size == members[0].file_size):
                with z.open(members[0]) as a, (part := out.with_suffix(".part")).open("wb") as b:
                    shutil.copyfileobj(a, b, CHUNK)
                if part.stat().st_size != members[0].file_size:
                    raise ValueError(f"{archive}: the extracted size differs")
                part.rename(out)
            return out
    except zipfile.BadZipFile:
        return recover_single(archive, folder)


def recover_single(archive: str | Path, folder: str | Path) -> Path:
    """The first member of an archive without a usable directory, read from its local header on."""
    with Path(archive).open("rb") as f:
        head = f.read(30)
        if head[:4] != LOCAL_HEADER:
            raise ValueError(f"{archive}: no local header")
        flags, method = struct.unpack_from("<HH", head, 6)
        packed, size, name_length, extra = struct.unpack_from("<IIHH", head, 18)
        name = f.read(name_length).decode("utf-8", "replace")
        f.seek(extra, 1)
        out = Path(folder) / Path(name).name
        with out.open("wb") as to:
            if method == STORED:
                left = packed or (1 << 62)
                while left and (chunk := f.read(min(CHUNK, left))):
                    to.write(chunk)
                    left -= len(chunk)
            elif method == DEFLATED:
                inflate = zlib.decompressobj(-15)
                while not inflate.eof and (chunk := f.read(CHUNK)):
                    to.write(inflate.decompress(chunk))
                to.write(inflate.flush())
            else:
                raise ValueError(f"{archive}: method {method}")
    if size and not flags & 8 and out.stat().st_size != size:
        raise ValueError(f"{archive}: the recovered size differs")
    return out


def extract_all(archive: str | Path, folder: str | Path) -> Path:
    """Every member, under ``folder``."""
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    return Path(folder)
