"""JSON patches on documents: add, replace and remove."""

from __future__ import annotations

import copy


class PatchFault(ValueError):
    pass


def _steps(path: str) -> list[str]:
    if path and not path.startswith("/"):
        raise PatchFault(f"{path!r} is no pointer")
    return [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]


def _index(text: str, size: int) -> int:
    if not text.isdigit() or text != str(int(text)) or int(text) >= size:
        raise PatchFault(f"{text!r} is no index here")
    return int(text)


def get(document, path: str):
    for step in _steps(path):
        if isinstance(document, list):
            document = document[_index(step, len(document))]
        elif isinstance(document, dict) and step in document:
            document = document[step]
        else:
            raise PatchFault(f"{path} is not there")
    return document


def apply(document, operations: list[dict]):
    """A patched copy; objects that an add passes through are made where they are missing."""
    document = copy.deepcopy(document)
    for operation in operations:
        kind, steps = operation.get("op"), _steps(operation.get("path", ""))
        if kind not in ("add", "replace", "remove"):
            raise PatchFault(f"{kind!r} is no operation")
        if not steps:
            raise PatchFault("the whole document cannot be patched")
        at = document
        for step in steps[:-1]:
            if isinstance(at, list):
                at = at[_index(step, len(at))]
            elif isinstance(at, dict):
                if step not in at:
                    if kind != "add":
                        raise PatchFault(f"{operation['path']} is not there")
                    at[step] = {}
                at = at[step]
            else:
                raise PatchFault(f"{operation['path']} passes through a value")
        last, value = steps[-1], copy.deepcopy(operation.get("value"))
        if isinstance(at, list):
            if kind == "add":
                at.insert(len(at) if last == "-" else _index(last, len(at) + 1), value)
            elif kind == "replace":
                at[_index(last, len(at))] = value
            else:
                del at[_index(last, len(at))]
        elif isinstance(at, dict):
            if kind != "add" and last not in at:
                raise PatchFault(f"{operation['path']} is not there")
            if kind == "remove":
                del at[last]
            else:
                at[last] = value
        else:
            raise PatchFault(f"{operation['path']} passes through a value")
    return document
