"""From what a user names to a file: a path, a portal's abbreviation, or an address, kept in a cache."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.error
import urllib.request
from pathlib import Path

PORTAL = "gii:"
#: Fixed value: where the federal portal publishes its laws, and its directory.
FEDERAL, DIRECTORY = "https://www.gesetze-im-internet.de", "gii-toc.xml"


def portal_id(name: str) -> str:
    return re.sub("[^a-z0-9-]", "_", name.strip().lower())


def cache_dir() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "lexloom"


def cache_path(url: str) -> Path:
    name = re.sub("[?#].*$", "", url).rsplit("/", 1)[-1] or "index"
    return cache_dir() / f"{hashlib.sha256(url.encode()).hexdigest()[:16]}-{name}"


def pick(names: list[str], wanted: str) -> str:
    """The one directory entry that is the wanted name or a variant of it ("name_…"); several are listed in the error."""
    hits = [x for x in names if x == wanted or x.startswith(f"{wanted}_")]
    if len(hits) != 1:
        raise LookupError(f"{wanted}: {len(hits)} entries{': ' + ', '.join(hits) if hits else ''}")
    return hits[0]


def download(url: str, timeout: float = 60.0) -> bytes:
    """Proxies and their credentials come from the environment, as urllib reads it."""
    with urllib.request.urlopen(url, timeout=timeout) as response:
        return response.read()


def _kept(url: str, get) -> bytes:
    """What an address gives, from the cache if it is there; an unwritable cache is no error."""
    path = cache_path(url)
    if path.exists():
        return path.read_bytes()
    data = get(url)
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_bytes(data)
        part.replace(path)
    except OSError:
        pass
    return data


def fetch(reference: str, portal: str = FEDERAL, get=download) -> bytes:
    """An existing path wins, then "gii:abbreviation" on the portal, then an address; what was downloaded is kept.

    An abbreviation that the portal does not have is looked up in its directory.
    """
    if os.path.exists(reference):
        return Path(reference).read_bytes()
    if reference.startswith(PORTAL):
        base, name = portal.rstrip("/"), portal_id(reference.removeprefix(PORTAL))
        try:
            return _kept(f"{base}/{name}/xml.zip", get)
        except urllib.error.HTTPError as x:
            if x.code != 404:
                raise
        listed = re.findall(r"/([a-z0-9_-]+)/xml\.zip", get(f"{base}/{DIRECTORY}").decode("utf-8", "replace"))
        return _kept(f"{base}/{pick(list(dict.fromkeys(listed)), name)}/xml.zip", get)
    if not re.match("https?://", reference):
        raise FileNotFoundError(reference)
    return _kept(reference, get)
