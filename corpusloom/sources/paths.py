"""Paths as users write them."""

from __future__ import annotations

import os
import re


def expanded(path: str) -> str:
    """`~` and `~/...` by the home folder; no other forms of it."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def from_windows(path: str, distro: str | None = None) -> str:
    """Windows forms under a Linux subsystem: its network share prefix and drive letters."""
    if m := re.match(r"^[\\/]{2}wsl(?:\.localhost|\$)[\\/]([^\\/]+)([\\/].*)?$", path, re.I):
        if distro is None or m[1].lower() == distro.lower():
            return (m[2] or "/").replace("\\", "/")
    if m := re.match(r"^([A-Za-z]):[\\/](.*)$", path):
        return f"/mnt/{m[1].lower()}/" + m[2].replace("\\", "/")
    return path


def resolved(root: str, path: str) -> str:
    """Joined to the root unless absolute, with `.` and `..` taken out by name, never above `/`.

    If that doesn't exist and has backslashes, it is tried with slashes.
    """
    path = expanded(path)
    whole = os.path.normpath(os.path.join(root, path))
    if "\\" in path and not os.path.lexists(whole):
        other = os.path.normpath(os.path.join(root, path.replace("\\", "/")))
        if os.path.lexists(other):
            return other
    return "/" + whole.lstrip("/") if whole.startswith("//") else whole


def shown(path: str, root: str, target: str) -> str:
    """Relative to the target while that lies under the root, else absolute."""
    under = target == root or target.startswith(root.rstrip("/") + "/")
    return os.path.relpath(path, target).replace(os.sep, "/") if under else path
