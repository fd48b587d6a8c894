"""Changes of a folder as a stream: added, rewritten and deleted exports.

The file source of Spark reports new names only. This source compares listings: its offset is the
listing itself (one entry per export: total size, latest time), so a query resumes from its checkpoint
with exactly the changes since its last batch, and an unchanged folder starts no batch.
"""

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def listing(folder: str, exclude=()) -> dict[str, list]:
    """Export name -> total size and latest time. An export is a file of the folder or a folder of
    files in it; hidden and temporary names do not count. Only metadata is read, on the driver."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        system, path = fs.FileSystem.from_uri(folder)
    else:
        system, path = fs.LocalFileSystem(), folder
    path = path.rstrip("/")
    found = {}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)):
        parts = info.path[len(path) :].strip("/").split("/")
        if info.type != fs.FileType.File or parts[0] in exclude or any(p[0] in "._~!" for p in parts):
            continue
        size, time = found.get(parts[0], (0, 0))
        found[parts[0]] = [size + info.size, max(time, info.mtime_ns or 0)]
    return found


def difference(now: dict, before: dict) -> dict[str, str]:
    """Export name -> added, changed or deleted."""
    kinds = {n: "added" if n not in before else "changed" for n in now if list(now[n]) != list(before.get(n, ()))}
    return kinds | {n: "deleted" for n in before if n not in now}


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.exclude = options["path"], [n for n in options.get("exclude", "").split("\n") if n]

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.folder, self.exclude)
        return iter(sorted(difference(now, start).items())), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(sorted(difference(end, start).items()))

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "name string, change string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def read_changes(spark: SparkSession, folder: str, exclude=()):
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("exclude", "\n".join(exclude)).load(folder)
