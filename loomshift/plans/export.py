"""Exports of a plan as text files, and secrets kept out of texts."""

from __future__ import annotations

import io
import re
import zipfile

from .plan import Plan

#: Keywords whose values are secrets.
SECRET_KEYS = ("password", "pwd", "secret", "token", "accountkey")


def scrub(text: str, secrets: list[str] = ()) -> str:
    """text without the given secrets (of four characters or more, as they are and with quotes doubled) and without values of secret keywords."""
    forms = {f for s in secrets if len(s) >= 4 for f in (s, s.replace("'", "''"), s.replace('"', '""'))}
    for form in sorted(forms, key=len, reverse=True):
        text = text.replace(form, "***")
    return re.sub(rf"(?i)\b({'|'.join(SECRET_KEYS)})(\s*=\s*)(\"[^\"]*\"|'[^']*'|[^;&\s]+)", r"\1\2***", text)


def script_files(plan: Plan, pre: str = "", post: str = "") -> dict[str, str]:
    """name -> text: what runs first, a file for each task in order, what runs last, and a list of contents."""
    files = {"00_pre.sql": pre or "-- nothing to do\n"}
    for n, task in enumerate(plan.tasks, 1):
        head = [f"-- {task.id}: {task.target} ({task.mode}, chunks of {task.chunk_size} rows)"] + [f"-- {w}" for w in task.warnings]
        files[f"{n:02d}_{task.target.replace('.', '_')}.sql"] = "\n".join([*head, task.query.rstrip() + ";", *([task.merge_query.rstrip() + ";"] if task.merge_query else [])]) + "\n"
    files["99_post.sql"] = post or "-- nothing to do\n"
    files["README.txt"] = "Run in the order of the names.\n" + "".join(f"{name}\n" for name in sorted(files))
    return files


def script_pack(plan: Plan, pre: str = "", post: str = "") -> bytes:
    """The files as a zip that depends on their contents alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
        for name, text in sorted(script_files(plan, pre, post).items()):
            pack.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def text_listing(task_query: str, merge_query: str | None = None) -> list[tuple[int, str]]:
    """Numbered lines of a task's texts, counted through."""
    lines = [x for part in (task_query, merge_query) if part for x in part.replace("\r\n", "\n").split("\n")]
    return list(enumerate(lines, 1))
