"""Binary files that tasks write and read, on any file system the scratch folder is on."""

from __future__ import annotations

import contextlib
import uuid

from readmend.sources.files import resolve


def new_name(folder: str, kind: str) -> str:
    """A name that no other attempt of a task uses: only files that a finished task
    reports are ever read, so a lost or doubled attempt does no harm."""
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def writer(path: str):
    system, inner = resolve(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as f:
        yield f


@contextlib.contextmanager
def reader(path: str):
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        yield f
