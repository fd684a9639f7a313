"""File operations of a load, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Listing, moving and small text files below any path that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of the entries of a folder, in order; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def state(self, path: str) -> tuple[tuple[str, int, int], ...]:
        """Name, size and time of change of everything below a folder: what tells whether its data are the same."""
        out = []
        for s in self._fs.listStatus(self._path(path)):
            entry = s.getPath().toString()
            out += self.state(entry) if s.isDirectory() else [(entry, s.getLen(), s.getModificationTime())]
        return tuple(sorted(out))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, path: str, to: str) -> None:
        parent = self._path(to).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"could not move {path} to {to}")

    def write(self, path: str, text: str) -> None:
        """A small file that is there whole or not at all: written aside, then moved."""
        out = self._fs.create(self._path(f"{path}.part"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(f"{path}.part", path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def partition_folder(spark: SparkSession, column: str, value: str) -> str:
    """The folder name that Spark gives a partition."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{column}={escape(value)}"
