"""Tables in versions: a write adds files, and one atomic rename of a small pointer file makes them the current version.

Below a table's root, ``data/part=<id>`` holds what one write added, with a folder per slice if the table has a slice column, and ``current.json`` names
the parts and slices of the current version and of the few before it. A write that stops anywhere before the rename leaves the old
version in place; readers keep the version they opened until it is older than the retention. A table is read by one scan, which prunes slices.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "part"


class ConcurrentWrite(RuntimeError):
    """Another version was committed since the one that a change was based on."""


class Version(NamedTuple):
    """``paths`` are folders below ``data``; of a sliced table, each slice's value is beside its path, which is None for a slice left empty."""

    number: int
    paths: list[str]
    slices: dict[str, list[str] | None] | None
    slice_col: str | None
    schema: str

    def folders(self) -> list[str]:
        return self.paths if self.slices is None else [p for some in self.slices.values() for p in some or []]


class _Files:
    """The store that a path is in, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.root = spark.sparkContext, root.rstrip("/")
        self.jvm = self.sc._jvm
        self.fs = self.at("").getFileSystem(self.sc._jsc.hadoopConfiguration())

    def at(self, name: str) -> JavaObject:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside its place and move it there in one step."""
        staged = f".{name}-{uuid.uuid4().hex}"
        out = self.fs.create(self.at(staged))
        out.write(bytearray(text.encode()))
        out.close()
        how = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        overwrite = self.sc._gateway.new_array(how, 1)
        overwrite[0] = how.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.sc._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(self.at(staged)), self.fs.makeQualified(self.at(name)), overwrite)

    def folders(self, name: str) -> list[str]:
        if not self.fs.exists(self.at(name)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name)) if x.isDirectory())

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def value_of(self, folder: str) -> str | None:
        """The slice that a folder named column=value is for; None for null."""
        value = folder.partition("=")[2]
        return None if value == "__HIVE_DEFAULT_PARTITION__" else self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)


def _history(files: _Files) -> list[Version]:
    """The current version and those kept before it, newest first."""
    text = files.read("current.json")
    return [Version(**v) for v in json.loads(text)["versions"]] if text else []


def current_version(spark: SparkSession, root: str) -> Version | None:
    found = _history(_Files(spark, root))
    return found[0] if found else None


def read_version(spark: SparkSession, root: str, version: Version) -> DataFrame:
    """A version as a table; it stays readable until later writes have outrun the retention."""
    schema = T.StructType.fromJson(json.loads(version.schema))
    if not version.folders():
        return spark.createDataFrame([], schema)
    base = f"{root.rstrip('/')}/data"
    whole = T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])
    return spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/{p}" for p in version.folders()]).select(*schema.names)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current version; an error if nothing was ever committed."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no table at {root}")
    return read_version(spark, root, version)


def write_version(df: DataFrame, root: str, *, slice_col: str | None = None, retain: int = 2, based_on: int | None = None) -> Version:
    """Make ``df`` the whole table, as a new version; the ``retain`` versions before it stay readable.

    ``based_on``: the number of the version that ``df`` was computed from; a ConcurrentWrite is raised if another one has become current since. One
    writer at a time is assumed between that look and the rename.
    """
    return _commit(df, root, slice_col, retain, based_on, None)


def append_version(df: DataFrame, root: str, *, slice_col: str | None = None, cluster_by: str | None = None, retain: int = 2) -> Version:
    """Add rows to a table, or begin one; earlier files stay as they are. ``cluster_by`` sorts the files of a slice, so that reads skip row groups."""

    def added(old: Version | None, paths: list[str], slices: dict[str, list[str] | None] | None) -> tuple[list[str], dict[str, list[str] | None] | None]:
        before = (old.slices or {}) if old else {}
        both = None if slices is None else {**before, **{k: [*(before.get(k) or []), *(p or [])] for k, p in slices.items()}}
        return [*(old.paths if old else []), *paths], both

    return _commit(df, root, slice_col, retain, None, added, cluster_by)


def replace_slices(df: DataFrame, root: str, slice_col: str, values: Sequence[str | None], *, retain: int = 2) -> Version:
    """Replace the slices of ``values`` by their rows in ``df``, all of them in one write and one commit; other slices stay, without a copy.

    A slice without rows is left empty, as an entry of its own in the version. Rows of other slices are left out.
    """
    column = F.col(slice_col)
    wanted = column.isin([v for v in values if v is not None]) | (column.isNull() if None in values else F.lit(False))

    def swapped(old: Version | None, paths: list[str], slices: dict[str, list[str] | None] | None) -> tuple[list[str], dict[str, list[str] | None] | None]:
        new = {_name(v): (slices or {}).get(_name(v)) for v in values}
        return paths, {**((old.slices or {}) if old else {}), **new}

    return _commit(df.filter(wanted), root, slice_col, retain, None, swapped)


def change_current(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], *, retain: int = 2) -> Version:
    """A new version that ``change`` makes of the current one."""
    old = current_version(spark, root)
    if old is None:
        raise FileNotFoundError(f"no table at {root}")
    return write_version(change(read_version(spark, root, old)), root, slice_col=old.slice_col, retain=retain, based_on=old.number)


def remove_orphans(spark: SparkSession, root: str) -> list[str]:
    """Delete the files of writes that never became a version; call it while nobody writes."""
    files = _Files(spark, root)
    used = {p.partition("/")[0] for v in _history(files) for p in v.folders()}
    lost = [f for f in files.folders("data") if f not in used]
    for folder in lost:
        files.delete(f"data/{folder}")
    return lost


def _name(value: Any) -> str:
    """A slice's key in a version: JSON, so that null differs from text."""
    return json.dumps(None if value is None else str(value))


_Join = Callable[[Version | None, list[str], "dict[str, list[str] | None] | None"], "tuple[list[str], dict[str, list[str] | None] | None]"]


def _commit(df: DataFrame, root: str, slice_col: str | None, retain: int, based_on: int | None, join: _Join | None, cluster_by: str | None = None) -> Version:
    """Write the rows as a part, let ``join`` put it beside what the current version has (None: instead of it), and swap the pointer."""
    spark = df.sparkSession
    files = _Files(spark, root)
    part = f"{_PART}={uuid.uuid4().hex}"
    if slice_col:
        names = [*[c for c in df.columns if c != slice_col], slice_col]
        df = df.select(*names)
        # Rows of a slice meet in as many tasks as the adaptive plan makes of them, not in one file of every task.
        dealt = df.hint("rebalance", slice_col)
        dealt.sortWithinPartitions(slice_col, *[cluster_by] * bool(cluster_by)).write.partitionBy(slice_col).parquet(f"{files.root}/data/{part}")
        paths, slices = [], {_name(files.value_of(f)): [f"{part}/{f}"] for f in files.folders(f"data/{part}") if f.startswith(f"{slice_col}=")}
    else:
        df.write.parquet(f"{files.root}/data/{part}")
        paths, slices = [part], None
    history = _history(files)
    old = history[0] if history else None
    if based_on is not None and (old.number if old else 0) != based_on:
        raise ConcurrentWrite(f"version {old.number if old else 0} of {root} is newer than {based_on}")
    if join:
        if old and (old.slice_col != slice_col or T.StructType.fromJson(json.loads(old.schema)).names != df.columns):
            raise ValueError(f"{root} has other columns or slices")
        paths, slices = join(old, paths, slices)
    new = Version((old.number if old else 0) + 1, paths, slices, slice_col, df.schema.json())
    kept = [new, *history[:retain]]
    files.replace("current.json", json.dumps({"versions": [v._asdict() for v in kept]}))
    needed = {p for v in kept for p in v.folders()}
    for version in history[retain:]:
        for path in set(version.folders()) - needed:
            files.delete(f"data/{path}")
    return new
