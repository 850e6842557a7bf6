"""The error that operations raise: a code of the error table, and where it passed on its way up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from spacemill.sources.config import ERRORS

#: Codes by name.
CODES = {name: code for code, (name, _) in ERRORS.items()}
#: Places that an error keeps.
FRAMES = 8


class SpaceError(Exception):
    """An error of a named code, with at most FRAMES places that it passed and an optional detail."""

    def __init__(self, name: str, detail: str = ""):
        self.name, self.code, self.message = name, CODES[name], ERRORS[CODES[name]][1]
        self.detail, self.frames = detail, []
        super().__init__(name)

    def push(self, place: str) -> SpaceError:
        """Notes a place; those beyond FRAMES are left out."""
        if len(self.frames) < FRAMES:
            self.frames.append(place)
        return self

    def __str__(self) -> str:
        return "\n".join([f"{self.name}({self.code}): {self.message}" + (f" {self.detail}" if self.detail else ""), *(f"  {f}" for f in self.frames)])


@contextmanager
def passing(place: str) -> Iterator[None]:
    """Notes the place on errors that pass it."""
    try:
        yield
    except SpaceError as e:
        raise e.push(place)


def check(ok: bool, name: str, detail: str = "") -> None:
    """Raises the named error unless ok."""
    if not ok:
        raise SpaceError(name, detail)
