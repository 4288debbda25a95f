"""Files by URI, for code that runs in tasks.

Spark lists ``file:`` paths without percent-encoding, so only the prefix is
taken off (names may hold ``#`` or ``%``).  Other schemes go to the stores
that ``pyarrow.fs`` has; one that it lacks is an error, never a local path.
"""

from __future__ import annotations


def open_store(uri: str):
    """(file system, path in it) of a URI or an absolute local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        path = uri[len("file:"):]
        return fs.LocalFileSystem(), path[2:] if path.startswith("//") else path
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if "://" not in uri:
        raise NotImplementedError(f"neither a URI nor an absolute path: {uri}")
    try:
        return fs.FileSystem.from_uri(uri)
    except ValueError as exc:
        raise NotImplementedError(f"no store for {uri}: {exc}") from exc


def open_input(uri: str):
    """The file, open for reading at any place."""
    from pyarrow import fs

    store, path = open_store(uri)
    return open(path, "rb") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def write_file(uri: str, parts) -> int:
    """Write the byte strings ``parts`` to a file; return its size.

    They go to a name of this attempt's own first, which then takes the place
    of the file: two attempts of one task never mix.
    """
    import uuid

    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
    size = 0
    with store.open_output_stream(own, compression=None) as out:
        for part in parts:
            size += out.write(part) or len(part)
    store.move(own, path)
    return size
