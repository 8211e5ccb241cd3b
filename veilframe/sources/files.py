"""Files on the driver: where they are, whether they are complete, how they get there."""

from __future__ import annotations

import tarfile
import time
import urllib.request
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

#: Names of the files of the public data set.
RATING_FILES = tuple(f"combined_data_{k}.txt" for k in (1, 2, 3, 4))
TITLES_FILES = ("movie_titles.csv", "movie_titles.txt")
PAIRS_FILE = "probe.txt"


def data_files(folder: str | Path) -> dict[str, Path]:
    """Name -> path; of the titles files the CSV is preferred."""
    folder = Path(folder)
    titles = next((folder / t for t in TITLES_FILES if (folder / t).exists()), folder / TITLES_FILES[0])
    return {**{f: folder / f for f in RATING_FILES}, "titles": titles, "pairs": folder / PAIRS_FILE}


def missing_files(folder: str | Path, pairs: bool = True) -> list[str]:
    """Names of the files that aren't there; pairs: whether the held-out pairs are needed."""
    return [p.name for k, p in data_files(folder).items() if not p.exists() and (pairs or k != "pairs")]


def verify_files(folder: str | Path, pairs: bool = True) -> dict:
    held = data_files(folder)
    missing = missing_files(folder, pairs)
    return {"ok": not missing, "missing": missing, "present": {p.name: p.stat().st_size for p in held.values() if p.exists()}}


def first_folder(candidates: Iterable[str | Path], pairs: bool = True) -> Path:
    """The first folder that has all files; else an error that lists what each lacks."""
    tried = []
    for c in map(Path, candidates):
        if c.is_dir() and not (missing := missing_files(c, pairs)):
            return c
        tried.append(f"{c}: {', '.join(missing) if c.is_dir() else 'no such folder'}")
    raise FileNotFoundError("; ".join(tried) or "no folder was named")


def download(url: str, to: str | Path, chunk: int = 1 << 20, opener: Callable = urllib.request.urlopen) -> Path:
    to = Path(to)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    with opener(url) as source, part.open("wb") as sink:
        while data := source.read(chunk):
            sink.write(data)
    part.replace(to)
    return to


def unpack(archive: str | Path, folder: str | Path) -> list[Path]:
    """Unpack a zip or tar file; an entry that would land outside the folder is an error and nothing is written."""
    archive, folder = Path(archive), Path(folder).resolve()

    def inside(name: str) -> Path:
        to = (folder / name).resolve()
        if not to.is_relative_to(folder):
            raise ValueError(f"{name} lies outside {folder}")
        return to

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            out = [inside(n) for n in z.namelist()]
            z.extractall(folder)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            if any(m.issym() or m.islnk() for m in t.getmembers()):
                raise ValueError("links in archives aren't unpacked")
            out = [inside(m.name) for m in t.getmembers()]
            t.extractall(folder, filter="data")
    else:
        raise ValueError(f"{archive} is neither a zip nor a tar file")
    return out


def ratings_url(person: str) -> str:
    """The address of a person's ratings: a full address as it is, else that of an id or name, with or without `user/` before it."""
    if person.startswith(("http://", "https://")):
        return person
    name = person.strip("/").removeprefix("user/")
    if not name:
        raise ValueError("an address, an id or a name is needed")
    return f"https://www.imdb.com/user/{name}/ratings"


def scrape_ratings(person: str, name: str, fetch: Callable[[str], str], pause: float = 0.0) -> list[tuple]:
    """Rows of a person's first page of ratings; an empty page is an error. fetch: the page of an address; pause: seconds after it."""
    from veilframe.sources.html_ratings import page_rows

    rows = page_rows(fetch(ratings_url(person)), name)
    if pause > 0:
        time.sleep(pause)
    if not rows:
        raise ValueError(f"no ratings on the page of {person}")
    return rows
