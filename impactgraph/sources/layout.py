"""Where a repository's modules and tests begin."""

from __future__ import annotations

import glob
import os
import tomllib
from collections.abc import Mapping

from ..functions.names import Discovery
from .settings import Settings

# Folders at the top of a repository that hold modules, and those that hold tests.
SOURCE_FOLDERS = ["src", "lib", "packages", "backend", "frontend", "pkg"]
TEST_FOLDERS = ["tests", "test", "t", "spec"]
LINK_FILES = ["*.pth", "*.egg-link", "*/*.pth", "*/*.egg-link"]


def inside(repo: str, path: str, base: str | None = None) -> str | None:
    """An existing folder below repo, relative to it; None for any other."""
    whole = os.path.realpath(os.path.join(base or repo, os.path.expanduser(path)))
    rel = os.path.relpath(whole, os.path.realpath(repo)).replace(os.sep, "/")
    return None if rel == "." or rel.startswith("..") or not os.path.isdir(whole) else rel


def project_roots(repo: str) -> list[str]:
    """Folders that the project file names: packages' from, and where packages are found."""
    try:
        with open(os.path.join(repo, "pyproject.toml"), "rb") as f:
            tool = tomllib.load(f).get("tool", {})
        packages = tool.get("poetry", {}).get("packages", [])
        found = [p["from"] for p in packages if isinstance(p, dict) and p.get("from")]
        setup = tool.get("setuptools", {}).get("packages", {})
        return found + list(setup.get("find", {}).get("where", []) if isinstance(setup, dict) else [])
    except (OSError, tomllib.TOMLDecodeError, AttributeError, TypeError):
        return []


def linked_roots(repo: str) -> list[str]:
    """Folders that path files of editable installs point to, in the repository's top or one folder down."""
    found = []
    for pattern in LINK_FILES:
        for name in sorted(glob.glob(os.path.join(glob.escape(repo), pattern))):
            try:
                with open(name, encoding="utf-8") as f:
                    lines = [x.strip() for x in f]
            except (OSError, UnicodeDecodeError):
                continue
            found += [inside(repo, x, os.path.dirname(name)) for x in lines if x and not x.startswith(("import ", "#"))]
    return [x for x in found if x]


def import_roots(repo: str, env: Mapping[str, str] | None = None) -> list[str]:
    """Roots of module names below the top, longest first."""
    told = (os.environ if env is None else env).get("PYTHONPATH", "").split(os.pathsep)
    named = [inside(repo, x) for x in [*filter(None, told), *project_roots(repo), *SOURCE_FOLDERS]]
    return sorted({x for x in [*named, *linked_roots(repo)] if x}, key=lambda x: (-x.count("/"), x))


def test_roots(repo: str) -> list[str]:
    return [x for x in TEST_FOLDERS if os.path.isdir(os.path.join(repo, x))]


def discovery(repo: str, settings: Settings | None = None) -> Discovery:
    """What counts as a test here: defaults, widened where a test folder exists, overruled by the settings."""
    settings = settings or Settings(repo)
    out = Discovery()
    found = test_roots(repo)
    if found:
        out.directories = list(dict.fromkeys([*found, "test", "t", "spec", *out.directories]))
        out.files = [*out.files, "*_test.py"]
    pick = lambda key, default: settings.value("test_discovery", key, default)
    return Discovery(
        pick("framework", out.framework), pick("directories", out.directories), pick("patterns", out.files), pick("class_patterns", out.classes), pick("function_patterns", out.functions)
    )
