"""Unified diffs: parsed to rows, verified against sources, mapped to symbols."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_BYTES, MAX_FILES, MAX_LINES = 5_000_000, 1000, 200_000
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}


class DiffError(ValueError):
    """Not a unified diff this reader takes."""


@dataclass
class FilePatch:
    old: str | None
    new: str | None
    status: str = "MODIFIED"
    binary: bool = False
    symlink: bool = False
    submodule: bool = False
    #: (kind, old line, new line, text, ends with a line feed)
    lines: list[tuple[str, int | None, int | None, str, bool]] = field(default_factory=list)


def unquote(path: str) -> str:
    """A path as git writes it, C-quoted where it has to be."""
    if not (path.startswith('"') and path.endswith('"') and len(path) > 1):
        return path
    out, i, body = bytearray(), 0, path[1:-1]
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
        elif m := re.match(r"[0-7]{3}", body[i + 1 :]):
            out.append(int(m[0], 8))
            i += 4
        else:
            out.append(_ESCAPES[body[i + 1]])
            i += 2
    return out.decode()


def _side(text: str, prefix: str) -> str | None:
    p = unquote(text.split("\t")[0] if not text.startswith('"') else text)
    p = None if p == "/dev/null" else p.removeprefix(prefix)
    if p is not None and (p.startswith("/") or ".." in p.split("/") or "\0" in p):
        raise DiffError("a path leaves the tree")
    return p


def parse(text: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES, max_lines: int = MAX_LINES) -> list[FilePatch]:
    """Files of a diff in order. Combined diffs, NUL bytes, bad counts and anything over the limits are rejected."""
    if len(text.encode()) > max_bytes or "\0" in text:
        raise DiffError("too large, or not text")
    rows, out, now, i, taken = text.split("\n"), [], None, 0, 0
    while i < len(rows):
        row = rows[i]
        if row.startswith(("diff --cc", "diff --combined", "@@@")):
            raise DiffError("combined diffs have no sides")
        if row.startswith("diff --git "):
            m = re.fullmatch(r'diff --git ("(?:[^"\\]|\\.)*"|a/.*) ("(?:[^"\\]|\\.)*"|b/.*)', row)
            out.append(now := FilePatch(_side(m[1], "a/"), _side(m[2], "b/")) if m else FilePatch(None, None))
        elif row.startswith("--- ") and i + 1 < len(rows) and rows[i + 1].startswith("+++ "):
            if now is None or now.lines:
                out.append(now := FilePatch(None, None))
            now.old, now.new = _side(row[4:], "a/"), _side(rows[i + 1][4:], "b/")
            now.status = "ADDED" if now.old is None else "REMOVED" if now.new is None else now.status
            i += 1
        elif now is not None and row.startswith("@@ "):
            m = _HUNK.match(row)
            if not m:
                raise DiffError("a hunk without ranges")
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            while n > 0 or k > 0:
                i += 1
                if i >= len(rows):
                    raise DiffError("a hunk is cut off")
                kind, body = (rows[i][:1] or " "), rows[i][1:]
                if kind == "\\":
                    now.lines[-1] = (*now.lines[-1][:4], False)
                    continue
                if kind not in " +-" or (kind != "+" and n == 0) or (kind != "-" and k == 0):
                    raise DiffError("a hunk's counts are wrong")
                now.lines.append((kind, a if kind != "+" else None, b if kind != "-" else None, body, True))
                a, n = (a + 1, n - 1) if kind != "+" else (a, n)
                b, k = (b + 1, k - 1) if kind != "-" else (b, k)
                taken += 1
            if i + 1 < len(rows) and rows[i + 1].startswith("\\"):
                now.lines[-1] = (*now.lines[-1][:4], False)
                i += 1
        elif now is not None:
            if row.startswith(("new file mode ", "deleted file mode ", "old mode ", "new mode ")):
                mode = row.split()[-1]
                now.symlink |= mode == "120000"
                now.submodule |= mode == "160000"
                now.status = "ADDED" if row.startswith("new file") else "REMOVED" if row.startswith("deleted") else now.status
                now.old, now.new = (None, now.new) if row.startswith("new file") else (now.old, None) if row.startswith("deleted") else (now.old, now.new)
            elif row.startswith(("rename from ", "copy from ")):
                now.old, now.status = unquote(row.split(" from ", 1)[1]), "RENAMED" if row.startswith("rename") else "COPIED"
            elif row.startswith(("rename to ", "copy to ")):
                now.new = unquote(row.split(" to ", 1)[1])
            elif row.startswith(("Binary files ", "GIT binary patch")):
                now.binary = True
        if len(out) > max_files or taken > max_lines:
            raise DiffError("too many files or lines")
        i += 1
    return out


def applies(patch: FilePatch, base: str, head: str) -> bool:
    """Whether applying the patch to base gives head, byte for byte."""
    old, out, at = base.split("\n"), [], 0
    for kind, a, _, body, _ in patch.lines:
        if kind == "+":
            out.append(body)
            continue
        if a - 1 < at or a > len(old) or old[a - 1] != body:
            return False
        out += old[at : a - 1]
        at = a
        if kind == " ":
            out.append(body)
    return _ends(out + old[at:], patch, base) == head


def _ends(rows: list[str], patch: FilePatch, base: str) -> str:
    text = "\n".join(rows)
    last = [r for r in patch.lines if r[0] != "-"]
    if not base and text and patch.lines:  # a new file: its last row says how it ends
        return text.rstrip("\n") + ("\n" if last and last[-1][4] else "")
    if last and not last[-1][4]:
        return text.rstrip("\n")
    gone = [r for r in patch.lines if r[0] == "-" and not r[4]]
    return text + "\n" if gone and last and last[-1][4] and not text.endswith("\n") else text


LINES = "file_no int, old_path string, new_path string, status string, binary boolean, kind string, old_line int, new_line int, text string, error string"


class DiffLines:
    """The table function's handler: a row for each line (or file without lines) of a diff; a diff that can't be read is one row with its error."""

    def eval(self, text: str):
        try:
            files = parse(text or "")
        except DiffError as e:
            yield None, None, None, None, None, None, None, None, None, str(e)
            return
        for n, f in enumerate(files):
            for kind, a, b, body, _ in f.lines or [(None, None, None, None, True)]:
                yield n, f.old, f.new, f.status, f.binary, kind, a, b, body, None


def register(spark) -> None:
    """SELECT * FROM parse_diff(text), also LATERAL over a column."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_diff", udtf(DiffLines, returnType=LINES))
