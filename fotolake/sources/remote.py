"""A remote folder listing (nested JSON) as files with absolute paths and metadata."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.media import extension, parent_name, stem

SCHEMA = "fileid long, path string, size long, created long, modified long, width string, height string"


def _number(v) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def flatten(document: str | None, root: str = "/") -> list[tuple]:
    """Files of one listing. Nameless entries are skipped, folders entered, files need a `fileid`; damaged JSON is empty."""
    try:
        top = json.loads(document) if document else {}
    except ValueError:
        return []
    top = top.get("metadata", top) if isinstance(top, dict) else {}
    out, todo = [], [(root.rstrip("/"), top.get("contents") or [])]
    while todo:
        folder, items = todo.pop()
        for item in items:
            name = item.get("name") if isinstance(item, dict) else None
            if not isinstance(name, str) or not name:
                continue
            path = f"{folder}/{name}"
            if item.get("isfolder") is True:
                todo.append((path, item.get("contents") or []))
            elif (fid := _number(item.get("fileid"))) is not None and fid >= 0:
                text = lambda k: None if _number(item.get(k)) is None else str(item[k])  # noqa: E731, B023
                out.append((fid, path, max(_number(item.get("size")) or 0, 0), _number(item.get("created")), _number(item.get("modified")), text("width"), text("height")))
    return out


#: A remote call: method name and parameters to the answer, parsed.
Call = Callable[[str, dict], dict]
# Names of the remote methods.
LIST, RENAME, CREATE = "listfolder", "renamefile", "createfolderifnotexists"


def http_call(base: str, auth: dict[str, str], timeout: float = 60.0) -> Call:
    """Calls over HTTP: `base/method?parameters`, answers in JSON with a `result` of 0 or an `error`."""

    def call(method: str, params: dict) -> dict:
        query = urlencode({k: str(v) for k, v in {**params, **auth}.items()})
        with urlopen(f"{base.rstrip('/')}/{method}?{query}", timeout=timeout) as r:  # noqa: S310 - the caller's address
            return json.loads(r.read())

    return call


def _checked(answer: dict) -> dict:
    if answer.get("result", 0) != 0:
        raise OSError(f"{answer.get('result')}: {answer.get('error', 'remote call failed')}")
    return answer


def list_remote(spark: SparkSession, call: Call, folder: str = "/", recursive: bool = True) -> DataFrame:
    """The files below a remote folder (see `remote_files`), from one listing."""
    params = {"path": folder, "timeformat": "timestamp"} | ({"recursive": 1} if recursive else {})
    return remote_files(spark.createDataFrame([(json.dumps(_checked(call(LIST, params))),)], "json string"), root=folder)


def apply_remote(call: Call, moves: list[tuple[int, str, str]]) -> list[tuple[int, str, str, str | None]]:
    """Rename remote files: (fileid, from, to) in order, each with why it failed or None. Folders on the way are made first, from the top.

    Remote calls are made one by one, as their interface wants; a plan is what one person renames.
    """
    made, out = {"", "/"}, []
    for fileid, src, dst in moves:
        try:
            parts = dst.split("/")[1:-1]
            for depth in range(1, len(parts) + 1):
                folder = "/" + "/".join(parts[:depth])
                if folder not in made:
                    _checked(call(CREATE, {"path": folder}))
                    made.add(folder)
            _checked(call(RENAME, {"fileid": fileid, "topath": dst}))
            out.append((fileid, src, dst, None))
        except OSError as e:
            out.append((fileid, src, dst, str(e)))
    return out


def undo_remote(call: Call, applied: list[tuple[int, str, str, str | None]]) -> list[tuple[int, str, str, str | None]]:
    """Rename back what was done, last first."""
    return apply_remote(call, [(i, dst, src) for i, src, dst, why in reversed(applied) if why is None])


def remote_files(documents: DataFrame, column: str = "json", root: str = "/") -> DataFrame:
    """Listing documents to file rows: fileid, path, name, ext, parent, size, date_created, date_modified, width, height."""

    def run(batches):
        for pdf in batches:
            rows = [r for d in pdf[column] for r in flatten(d, root)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({c: "Int64" for c in ("fileid", "size", "created", "modified")})

    f = documents.select(column).mapInPandas(run, SCHEMA)
    return f.select("fileid", "path", stem().alias("name"), extension().alias("ext"), parent_name().alias("parent"), "size", F.timestamp_seconds("created").alias("date_created"), F.timestamp_seconds("modified").alias("date_modified"), "width", "height")
