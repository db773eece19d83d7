"""Folders that the library uses where none are named, by operating system."""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping

NAME = "shoebox"
QUARANTINE = "격리보관함"  # fixed value: the quarantine folder's name


def data_dir(platform: str | None = None, env: Mapping[str, str] | None = None, home: str | None = None) -> str:
    """The user's folder for application data. Nothing is created."""
    platform, env, home = platform or sys.platform, os.environ if env is None else env, home or os.path.expanduser("~")
    if platform == "win32":
        base = env.get("APPDATA") or home
    elif platform == "darwin":
        base = os.path.join(home, "Library", "Application Support")
    else:
        base = env.get("XDG_DATA_HOME") or os.path.join(home, ".local", "share")
    return os.path.join(base, NAME)


def store_dir() -> str:
    return os.path.join(data_dir(), "library")


def thumb_dir() -> str:
    return os.path.join(data_dir(), "thumbnails")


def quarantine_dir() -> str:
    return os.path.join(data_dir(), QUARANTINE)
