"""Settings and project identity."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.vectors import stable_id

DEFAULTS = {"max_file_bytes": "512000", "embedding_width": "64", "budget_chars": "18000", "quiet_ms": "250", "batch_files": "1000", "retry_attempts": "5", "burst_threshold": "100"}


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; quotes are stripped, comments and other lines left out."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    out[m[1]] = re.sub(r"^([\"'])(.*)\1$", r"\2", m[2])
    return out


def settings(override: dict | None = None, env: dict | None = None, file: dict | None = None, prefix: str = "ORRERY_") -> dict[str, tuple[str, str]]:
    """{name: (value, where from)}; override goes before environment, file and default."""
    env = os.environ if env is None else env
    out = {}
    for name, default in DEFAULTS.items():
        places = [("override", (override or {}).get(name)), ("env", env.get(prefix + name.upper())), ("file", (file or {}).get(name)), ("default", default)]
        where, value = next((w, v) for w, v in places if v is not None)
        out[name] = (str(value), where)
    return out


def git_remote(config_text: Column) -> Column:
    """The URL of origin in a git config, or null."""
    return F.nullif(F.regexp_extract(config_text, r'\[remote "origin"\][^\[]*?\n\s*url\s*=\s*(\S+)', 1), F.lit(""))


def project_id(root: Column, remote: Column) -> Column:
    return stable_id(F.lower(root), remote)


@dataclass
class Hints:
    """What a request says about where it belongs."""

    file_path: str | None = None
    root: str | None = None
    roots: tuple[str, ...] = ()
    cwd: str | None = None


class Ambiguous(Exception):
    """More than one project fits, or none."""


def resolve_workspace(hints: Hints, roots: list[str]) -> str:
    """The project root that a request means: by file, root, roots, working directory, or being the only one. Ambiguity fails."""

    def around(path: str) -> list[str]:
        p = path.replace("\\", "/").rstrip("/").lower()
        hit = [r for r in roots if p == r.lower().rstrip("/") or p.startswith(r.lower().rstrip("/") + "/")]
        longest = max(map(len, hit), default=0)
        return [r for r in hit if len(r) == longest]

    for place in (hints.file_path, hints.root, *([hints.roots[0]] if len(hints.roots) == 1 else []), hints.cwd):
        if place:
            found = around(place)
            if len(found) == 1:
                return found[0]
            if len(found) > 1 or place in (hints.file_path, hints.root):
                raise Ambiguous(place)
    if len(roots) == 1:
        return roots[0]
    raise Ambiguous("no project, or several")
