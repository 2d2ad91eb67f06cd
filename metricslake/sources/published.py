"""Tables that change together: versioned directories behind one small pointer.

A set of tables lives under one root. Each write goes to a directory of its own; a pointer, numbered and
written last, names the directories that make up every table of the set. So a reader sees all
tables of one number, and a stop at any step leaves the old state or the new one: what has
been written without a pointer is never read. Nothing is moved or rewritten, and nobody has to guess.

``root/_published/00000007.json`` is pointer 7: ``{"tables": {name: [directory, ...]}, "step": 3}``.
It is written beside its place and renamed, so it is whole once it has its name; a name that is taken
means that another writer was faster (the local file system alone does not refuse the rename, so
two writers at the same moment need storage that does).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from metricslake.sources import lake

POINTERS = "_published"
KEEP_UNNAMED = dt.timedelta(days=1)  # a writer may take this long before its pointer names a directory


class State(NamedTuple):
    """What a pointer says: its number (0: nothing published), the directories of each table, the last step."""

    number: int
    tables: dict[str, list[str]]
    step: int | None


class Conflict(RuntimeError):
    """Another writer has published since the state that a change was made from."""


def _numbers(spark: SparkSession, root: str) -> list[int]:
    paths = lake.list_files(spark, f"{lake.as_glob(root.rstrip('/'))}/{POINTERS}/*.json")
    return sorted(int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in paths)


def _pointer(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{POINTERS}/{number:08d}.json"


def state(spark: SparkSession, root: str, at: int | None = None) -> State:
    """The newest state, or that of pointer ``at`` (ValueError if it is not kept)."""
    numbers = _numbers(spark, root)
    if at is not None and at not in numbers:
        raise ValueError(f"{root} has no state {at}")
    if not numbers:
        return State(0, {}, None)
    number = numbers[-1] if at is None else at
    told = json.loads(lake.read_bytes(spark, _pointer(root, number)))
    return State(number, told["tables"], told["step"])


def publish(
    spark: SparkSession,
    root: str,
    replace: Mapping[str, DataFrame] | None = None,
    append: Mapping[str, DataFrame] | None = None,
    step: int | None = None,
    base: State | None = None,
) -> bool:
    """Replace and extend tables of the set in one step; the others stay as they are.

    The frames may read the tables they change. ``base`` is the state they were made from (default: the
    newest one); if another has been published since, nothing changes and :class:`Conflict` is raised.
    With ``step`` (a batch id, rising) a step that has been published already, or an earlier one, does
    nothing and returns False. A table cannot be replaced and extended at once.
    """
    replace, append = dict(replace or {}), dict(append or {})
    if both := sorted(set(replace) & set(append)):
        raise ValueError(f"replaced and extended at once: {', '.join(both)}")
    base = base or state(spark, root)
    if step is not None and base.step is not None and step <= base.step:
        return False
    tables, tag = {name: list(parts) for name, parts in base.tables.items()}, uuid.uuid4().hex[:12]
    for name, df in {**replace, **append}.items():
        part = f"{name}/v-{tag}"
        df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{part}")
        tables[name] = [*tables.get(name, []), part] if name in append else [part]
    _point(spark, root, base.number + 1, {"tables": tables, "step": base.step if step is None else step})
    return True


def _point(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """The switch: pointer ``number`` appears whole or not at all."""
    target, beside = _pointer(root, number), f"{root.rstrip('/')}/{POINTERS}/{uuid.uuid4().hex}.tmp"
    newest = _numbers(spark, root)[-1:]
    if newest and newest[0] >= number:
        raise Conflict(f"{root}: state {newest[0]} was published in the meantime")
    lake.write_bytes(spark, beside, json.dumps(content, sort_keys=True).encode())
    try:
        lake.rename(spark, beside, target)
    except (OSError, Py4JError) as e:
        if number in _numbers(spark, root):
            raise Conflict(f"{root}: state {number} was published in the meantime") from e
        raise


def read(spark: SparkSession, root: str, name: str, at: State | None = None) -> DataFrame:
    """One table of the set; pass the same ``state`` for several tables to see them as of one moment.

    Directories of a table may differ in columns: the result has all of them.
    """
    at = at or state(spark, root)
    if name not in at.tables:
        raise ValueError(f"{root} has no table {name}")
    paths = [lake.as_glob(f"{root.rstrip('/')}/{part}") for part in at.tables[name]]
    return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)


def merge_parts(spark: SparkSession, root: str, name: str) -> int:
    """Rewrite a table of many appended directories as one; returns how many there were."""
    now = state(spark, root)
    parts = len(now.tables[name])
    if parts > 1:
        publish(spark, root, replace={name: read(spark, root, name, now)}, base=now)
    return parts


def expire(spark: SparkSession, root: str, keep: int = 1, unnamed_for: dt.timedelta = KEEP_UNNAMED) -> list[str]:
    """Delete all but the last ``keep`` pointers, and the directories that no kept one names.

    Readers of an older state need its files, so ``keep`` says how far back they may be. A directory that no pointer
    names is deleted once it is older than ``unnamed_for``: before that its writer may still be at work.
    """
    if keep < 1:
        raise ValueError("the newest state stays")
    base, numbers = root.rstrip("/"), _numbers(spark, root)
    named = {part for n in numbers for parts in state(spark, root, n).tables.values() for part in parts}
    kept = {part for n in numbers[-keep:] for parts in state(spark, root, n).tables.values() for part in parts}
    for number in numbers[:-keep]:  # first the pointers: none may name what is gone
        lake.delete(spark, _pointer(root, number))
    age_limit = dt.datetime.now().timestamp() - unnamed_for.total_seconds()
    gone = []
    for path, changed in lake.modified(spark, f"{lake.as_glob(base)}/*/v-*"):
        part = "/".join(path.rstrip("/").rsplit("/", 2)[-2:])
        if part not in kept and (part in named or changed <= age_limit):
            lake.delete(spark, path)
            gone.append(part)
    return sorted(gone)
