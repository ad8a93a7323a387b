"""Small files and folders on any file system that Spark reaches, through Hadoop's own client."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(context._jsc.hadoopConfiguration())
        self._io = context._jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Names inside a folder, sorted; none if there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str | bytes) -> None:
        """A new file, whole or not at all; an existing one is an error, never replaced.

        The content goes to a file of its own first.  On a local file system that file is then linked under its name, elsewhere
        it is renamed without overwriting: of two writers one fails, wherever the store itself renames in one step (HDFS does).
        """
        temporary = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(content.encode() if isinstance(content, str) else content)
        stream.close()
        try:
            self._publish(temporary, self.at(name))
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                raise FileExistsError(f"{self.root}/{name}") from e
            raise
        finally:
            self._fs.delete(temporary, False)

    def _publish(self, temporary, target) -> None:
        jvm = self.spark.sparkContext._jvm
        if self._fs.getScheme() == "file":
            plain = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(plain(target), plain(temporary))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), none)

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self._fs.getContentSummary(self.at(name)).getLength()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self.at(old), self.at(new)):
            raise FileExistsError(f"{self.root}/{new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)
