"""Files and folders as the driver sees them."""

from __future__ import annotations

import glob as _glob
import os
import shutil
import tempfile
import uuid as _uuid


def valid_input(path: str | None) -> bool:
    return bool(path) and os.path.isfile(path)


def safe_to_write(path: str | None, overwrite: bool = False) -> bool:
    """Whether the path names a file that can be made, or written over if that is wanted."""
    if not path or os.path.isdir(path):
        return False
    return overwrite or not os.path.exists(path)


def find(pattern: str) -> list[str]:
    return sorted(_glob.glob(pattern, recursive=True))


def make_folder(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def scratch_folder(parent: str | None = None) -> str:
    return tempfile.mkdtemp(dir=parent)


def remove(path: str) -> bool:
    """Removes a file or a folder with all it holds; False if there is none."""
    if os.path.isdir(path):
        shutil.rmtree(path)
        return True
    if os.path.exists(path):
        os.remove(path)
        return True
    return False


def rename(source: str, target: str) -> None:
    shutil.move(source, target)


def size(path: str) -> int:
    return os.path.getsize(path)


def new_uuid() -> str:
    return str(_uuid.uuid4())
