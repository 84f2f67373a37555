"""Numbered manifests: small JSON files that say which folders of a table count.

Folders are written first and never changed; the manifest that names them is the commit. A reader takes the newest manifest, so it sees all of a
write or nothing, and asks the file system once, however many folders there are. One writer is assumed; a second one
that commits the same number is told so.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from pageloom.sources import fs

FOLDER = "manifest"


#: The highest number this process has met, by path. Numbers have no gaps, so looking on from there saves listing them all.
_met: dict[str, int] = {}


def _file(path: str, number: int) -> str:
    return f"{path}/{FOLDER}/{number:012d}.json"


def newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest of the table at ``path``; (0, {}) when there is none."""
    last = _met.get(path, 0)
    if not last or not fs.exists(spark, _file(path, last)):
        names = [n for n in fs.files(spark, f"{path}/{FOLDER}") if n.endswith(".json") and n[:-5].isdigit()]
        if not names:
            return 0, {}
        last = int(max(names)[:-5])
    while fs.exists(spark, _file(path, last + 1)):
        last += 1
    _met[path] = last
    return last, json.loads(fs.read_text(spark, _file(path, last)))


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make ``content`` the manifest with this number; fails when that number is taken."""
    target = _file(path, number)
    # Written aside and renamed, so nobody reads half of it.
    aside = f"{path}/{FOLDER}/.{number:012d}-{uuid.uuid4().hex}"
    fs.write_text(spark, aside, json.dumps(content))
    if fs.exists(spark, target) or not fs.rename(spark, aside, target):
        raise RuntimeError(f"{target} is there already: another writer was faster")
