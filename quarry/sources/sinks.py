"""Sinks: tables of (path, text), and trees of files."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame


def write_table(outputs: DataFrame, path: str, mode: str = "overwrite") -> None:
    outputs.write.mode(mode).parquet(path)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: local, or any that Arrow knows by its scheme (hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(root if re.match(r"[a-z][a-z0-9+.-]*://", root) else f"file://{os.path.abspath(root.removeprefix('file:'))}")


def _below(path: str) -> str:
    """A path without scheme and leading slash; one that would leave the folder is an error."""
    parts = [p for p in re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", path).split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a path below the folder: {path!r}")
    return "/".join(parts)


def write_tree(outputs: DataFrame, root: str, path_col: str | None = None) -> None:
    """One file per row below ``root``, a folder that all executors share: at ``out_path`` if there is that column, else at ``path``.

    A file appears whole or not at all, and rewriting it gives the same file, so a repeated task does no harm. Rows with a null path are left out, a null text is an empty file."""
    column = path_col or ("out_path" if "out_path" in outputs.columns else "path")

    def put(rows) -> None:
        system, top = _open(root)
        for path, text in rows:
            target = f"{top.rstrip('/')}/{_below(path)}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(temporary) as f:
                f.write((text or "").encode("utf-8", "replace"))
            system.move(temporary, target)

    outputs.where(f"{column} is not null").select(column, "text").foreachPartition(put)


def wipe(root: str) -> None:
    """Deletes a folder and what is in it, if there is one."""
    system, top = _open(root)
    if system.get_file_info(top).type == fs.FileType.Directory:
        system.delete_dir(top)
