"""Small metadata files, through Hadoop's file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str, text: str) -> bool:
        """Create a file that does not exist yet; False if it does. Creation is exclusive, the one atomic step that all rests on."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        try:
            out = self.fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        path = self._path(name)
        if not self.fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path) if not s.getPath().getName().startswith((".", "_")))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
