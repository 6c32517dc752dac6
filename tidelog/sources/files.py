"""Small files next to the data, through Hadoop's FileSystem, so that a store can lie wherever Spark can write."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import IOFailure


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_dir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, *, sync: bool = True) -> bool:
        """Put a whole file where there is none yet, as one step that only one writer can win. False if there is one.

        sync: the bytes are on the disk before the file is in place.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        own = f"{path}.{self._jvm.java.util.UUID.randomUUID().toString()}.new"
        _, q = self._at(own)
        local = fs.getUri().getScheme() == "file"
        try:
            stream = fs.create(q, False)
            try:
                stream.write(bytearray(text.encode()))
                if sync and not local:
                    stream.hsync()
            finally:
                stream.close()
            if local:  # its rename would replace a file; a hard link does not
                return self._link(q, p, sync)
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            options[0] = none
            context.rename(q, p, options)
            return True
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise IOFailure(str(e.java_exception)) from e
        finally:
            fs.delete(q, False)

    def _link(self, source, target, sync: bool) -> bool:
        try:
            if sync:
                self._sync(source.toUri().getPath())
            os.link(source.toUri().getPath(), target.toUri().getPath())
            if sync:
                self._sync(os.path.dirname(target.toUri().getPath()))
            return True
        except FileExistsError:
            return False

    @staticmethod
    def _sync(path: str) -> None:
        number = os.open(path, os.O_RDONLY)
        try:
            os.fsync(number)
        finally:
            os.close(number)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def same(self, source: str, target: str) -> bool:
        """Make target the same folder of files without moving a byte, by hard links; False where that can't be done."""
        (a, p), (b, q) = self._at(source), self._at(target)
        if a.getUri().getScheme() != "file" or b.getUri().getScheme() != "file":
            return False
        old, new = p.toUri().getPath(), q.toUri().getPath()
        os.makedirs(new, exist_ok=True)
        try:
            for name in os.listdir(old):
                os.link(os.path.join(old, name), os.path.join(new, name))
            return True
        except OSError:  # another disk
            b.delete(q, True)
            return False
