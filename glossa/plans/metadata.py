"""Closed sets of metadata with defaults; what isn't in them is dropped and a value of another kind is refused."""

from __future__ import annotations

import json
from datetime import date

from .. import __version__
from .durable import filesystem

DICTIONARY = {"Version": __version__, "Record": 0, "Format": "Html", "Keycasesensitive": False, "Stripkey": True, "Description": "", "Title": "", "Encoding": "UTF-8", "Creationdate": "", "Compressionlevel": 5, "Left2Right": True, "Stylesheet": ""}
ARCHIVE = {"Version": __version__, "Record": 0, "Format": "", "Keycasesensitive": True, "Stripkey": False, "Description": "", "Title": "", "Encoding": "UTF-8", "Creationdate": "", "Compressionlevel": 3}
FILE = "_glossa.json"  # a name that Spark's readers pass over


class InvalidMetadata(ValueError):
    """Metadata that isn't an object, or a value of the wrong kind."""


def merge(given: dict | str | None, defaults: dict) -> dict:
    """The defaults with what is given over them."""
    if isinstance(given, str):
        try:
            given = json.loads(given or "{}")
        except ValueError as e:
            raise InvalidMetadata(str(e)) from None
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise InvalidMetadata("metadata must be an object")
    kind = lambda v: "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "other"
    out = {}
    for k, v in defaults.items():
        if k in given and kind(given[k]) != kind(v):
            raise InvalidMetadata(f"{k} must be a {kind(v)}")
        out[k] = given.get(k, v)
    return out


def stamp(meta: dict, records: int, level: int, strip: bool | None) -> dict:
    """What compiling fills in."""
    return meta | {"Record": records, "Compressionlevel": level, "Creationdate": date.today().isoformat()} | ({} if strip is None else {"Stripkey": strip})


def save(folder: str, meta: dict) -> None:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{FILE}") as f:
        f.write(json.dumps(meta, indent=2, ensure_ascii=False).encode())


def load(folder: str) -> dict:
    fs, root = filesystem(folder)
    try:
        with fs.open_input_file(f"{root}/{FILE}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}
