"""Files in the shared folder, by URI, from inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> str:
    """Write under a private name, then rename: a repeated task replaces its file with an equal one."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    private = f"{root}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(private) as out:
        out.write(data)
    system.move(private, f"{root}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path to map where the shared folder is mounted; None for stores that can't be mapped."""
    system, path = fs.FileSystem.from_uri(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def listed(folder: str, ending: str) -> list[tuple[str, int]]:
    system, root = fs.FileSystem.from_uri(folder)
    infos = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f"{folder.rstrip('/')}/{i.base_name}", i.size) for i in infos if i.base_name.endswith(ending))
