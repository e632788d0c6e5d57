"""New contents of tables, written beside the published ones and swapped in when whole."""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

from portolan.scratch import file_system, remove

_ASIDE = ".publish-"    # folder of a publication, hidden from readers of the folder around it
_FORWARD = "journal"    # a publication's moves are decided: they are all to be made
_BACK = "journal-back"  # one failed: they are all to be undone
_HOME = "home"          # where the journal is, if not here


class Staged(NamedTuple):
    written: str        # folder of the new contents
    path: str           # the published table
    parts_only: bool    # replace only the partition folders that were written
    parts: tuple[str, ...] | None   # or these, with nothing where they were not
    like: str | None                # or those that are replaced of another staged table


class Swap(NamedTuple):
    """One folder to be replaced. `new` is there until it is in its place."""

    new: str            # "": nothing comes into the place
    place: str
    old: str            # where what was in the place goes


class Publication:
    """Stage any number of tables, then `commit` them all, or none.

    Nothing published is touched before `commit`. There the moves to be made are first
    written down in a journal beside the tables, which appears in one step; then old
    folders are moved aside and new ones take their place by rename. Each move can be
    told from the folders as made or not, so whoever finds the journal can go on:

    - a driver that is killed before the journal is there has published nothing;
    - one that is killed after it has published everything, as soon as the next
      `Publication` beside these tables, or `recover`, has made the other moves;
    - a rename that fails turns the journal round and moves everything back; if that
      fails too, `recover` goes on with it.

    Old contents go only when all moves are made or undone. On a file system with
    renames in one step a reader misses a table for an instant at most, but for a kill;
    readers that call `recover` first never do.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.run = uuid.uuid4().hex
        self.staged: list[Staged] = []
        self.unsettled = False

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, *_) -> None:
        if not self.unsettled:
            _tidy(self.spark, self._asides())

    def _asides(self) -> list[str]:
        return list(dict.fromkeys(self._aside(s.path) for s in self.staged))

    def _aside(self, path: str) -> str:
        return f"{_parent(path)}/{_ASIDE}{self.run}"

    def stage(self, path: str, parts_only: bool = False, parts: list[str] | None = None,
              like: str | None = None) -> str:
        """Where to write the new contents of the table at `path`: the whole table, the
        partition folders that are written (`parts_only`), the folders named (`parts`,
        each as "/a=1/b=2"), or those that are replaced of the staged table at `like`.
        What a killed publication beside it has decided is finished first."""
        path = path.rstrip("/")
        if self._aside(path) not in self._asides():
            recover(self.spark, _parent(path))
        written = f"{self._aside(path)}/new/{path.rpartition('/')[2]}"
        self.staged.append(Staged(written, path, parts_only, None if parts is None else tuple(parts),
                                  like and like.rstrip("/")))
        return written

    def beside(self, path: str, name: str) -> str:
        """A folder beside the table at `path` that goes with the publication."""
        return f"{self._aside(path)}/{name}"

    def take(self, folder: str, written: str) -> None:
        """Let a folder that was written `beside` be what is staged, if it is there."""
        if _exists(self.spark, folder):
            _move(self.spark, folder, written)

    def commit(self) -> None:
        swaps = [Swap(s.written + part if _exists(self.spark, s.written + part) else "", s.path + part,
                      f"{self._aside(s.path)}/old/{number}{part}")
                 for number, s in enumerate(self.staged) for part in self._parts(s)]
        asides = self._asides()
        if not asides:
            return
        for aside in asides[1:]:
            _write(self.spark, f"{aside}/{_HOME}", asides[0])
        self.unsettled = True
        _write(self.spark, f"{asides[0]}/{_FORWARD}", json.dumps([asides, swaps]))
        try:
            for swap in swaps:
                _make(self.spark, swap)
        except BaseException:
            self._give_up(asides[0], swaps)
            raise
        self.unsettled = False

    def _give_up(self, home: str, swaps: list[Swap]) -> None:
        _move(self.spark, f"{home}/{_FORWARD}", f"{home}/{_BACK}")
        for swap in reversed(swaps):
            _undo(self.spark, swap)
        self.unsettled = False

    def _parts(self, staged: Staged) -> list[str]:
        """What moves: the whole table (""), or partition folders of it."""
        if staged.like:
            model = next(s for s in self.staged if s.path == staged.like)
            whole = self._parts(model) == [""]
            return [""] if whole or not _exists(self.spark, staged.path) else self._parts(model)
        if not _exists(self.spark, staged.path):
            return [""]
        if staged.parts is not None:
            return sorted(staged.parts)
        if not staged.parts_only:
            return [""]
        files, place = file_system(self.spark, staged.written)
        found, open_folders = [], [(place, "")]
        while open_folders:
            folder, name = open_folders.pop()
            below = [s for s in files.listStatus(folder)
                     if s.isDirectory() and "=" in s.getPath().getName()]
            if not below and name:
                found.append(name)
            open_folders += [(s.getPath(), f"{name}/{s.getPath().getName()}") for s in below]
        return sorted(found)


def recover(spark: SparkSession, folder: str) -> int:
    """Finish, or undo, what publications beside the tables of `folder` decided and did
    not get done; how many there were. One listing if there is nothing to do.

    A publication that another driver is in the middle of is helped, not harmed: the same
    moves are made, by whoever comes first. What is staged and not decided stays.
    """
    found = 0
    for aside in _publications(spark, folder):
        home = _read(spark, f"{aside}/{_HOME}") or aside
        for journal, settle in ((_BACK, _undo), (_FORWARD, _make)):
            decided = _read(spark, f"{home}/{journal}")
            if decided:
                asides, swaps = json.loads(decided)
                swaps = [Swap(*swap) for swap in swaps]
                for swap in swaps if settle is _make else reversed(swaps):
                    settle(spark, swap)
                _tidy(spark, asides)
                found += 1
                break
    return found


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at `path`, after `recover`."""
    recover(spark, _parent(path))
    return _exists(spark, path)


def remove_abandoned(spark: SparkSession, folder: str, hours: float = 72) -> int:
    """Remove what publications staged beside the tables of `folder` and have not touched
    for `hours`, after `recover`; how many there were."""
    recover(spark, folder)
    files, _ = file_system(spark, folder)
    before, found = (time.time() - hours * 3600) * 1000, 0
    for aside in _publications(spark, folder):
        place = file_system(spark, aside)[1]
        below = [files.getFileStatus(place), *files.listStatus(place)]
        if max(s.getModificationTime() for s in below) < before:
            remove(spark, aside)
            found += 1
    return found


def _parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def _publications(spark: SparkSession, folder: str) -> list[str]:
    files, place = file_system(spark, folder)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    return [f"{folder.rstrip('/')}/{name}" for name in sorted(names) if name.startswith(_ASIDE)]


def _make(spark: SparkSession, swap: Swap) -> None:
    if not swap.new:
        if _exists(spark, swap.place):
            _move(spark, swap.place, swap.old)
    elif _exists(spark, swap.new):
        if _exists(spark, swap.place):
            _move(spark, swap.place, swap.old)
        _move(spark, swap.new, swap.place)


def _undo(spark: SparkSession, swap: Swap) -> None:
    if swap.new and not _exists(spark, swap.new) and _exists(spark, swap.place):
        _move(spark, swap.place, swap.new)
    if _exists(spark, swap.old):
        _move(spark, swap.old, swap.place)


def _tidy(spark: SparkSession, asides: list[str]) -> None:
    """Remove the folders of a publication, that with the journal last."""
    for aside in reversed(asides):
        remove(spark, aside)


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = file_system(spark, path)
    return files.exists(place)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, place = file_system(spark, source)
    goal = file_system(spark, target)[1]
    files.mkdirs(goal.getParent())
    if not files.rename(place, goal) and (files.exists(place) or not files.exists(goal)):
        raise OSError(f"cannot move {source} to {target}")


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    files, begun = file_system(spark, f"{path}.begun")
    stream = files.create(begun, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _move(spark, f"{path}.begun", path)


def _read(spark: SparkSession, path: str) -> str | None:
    files, place = file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
