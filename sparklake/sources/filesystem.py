"""Files of a table in any store that Spark reaches: local ones by the operating system, others by Hadoop's file systems."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from ..errors import ConfigurationError, EngineCapabilityError

#: Schemes that a table may live under, and what Hadoop calls them.
SCHEMES = {"": "file", "file": "file", "s3": "s3a", "s3a": "s3a", "hdfs": "hdfs", "viewfs": "viewfs", "abfss": "abfss", "gs": "gs"}


def spark_path(uri: str) -> str:
    """uri as Spark reads it; ConfigurationError for a scheme that isn't known."""
    p = urlparse(uri)
    if p.scheme not in SCHEMES:
        raise ConfigurationError(f"storage scheme {p.scheme!r} is not supported", uri=uri)
    return f"file://{os.path.abspath(p.path or uri)}" if SCHEMES[p.scheme] == "file" else f"{SCHEMES[p.scheme]}://{p.netloc}{p.path}"


#: Schemes whose file systems rename in one step and not onto an existing file.
ATOMIC_RENAME = frozenset({"file", "hdfs", "viewfs", "abfss"})


class Store:
    """The few operations that a table needs, under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, spark_path(root).rstrip("/")
        self.local = Path(unquote(urlparse(self.root).path)) if self.root.startswith("file:") else None

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.uri(name))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def put_new(self, name: str, data: bytes) -> bool:
        """Writes a file that doesn't exist yet, whole or not at all; False if it exists."""
        if self.local:
            target = self.local / name
            target.parent.mkdir(parents=True, exist_ok=True)
            staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            with open(staged, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(staged, target)
                return True
            except FileExistsError:
                return False
            finally:
                staged.unlink()
        fs, path = self._hadoop(name)
        if self.root.split(":")[0] in ATOMIC_RENAME:
            return self._put_by_rename(fs, path, data)
        return self._put_on_condition(fs, path, data)

    def _put_by_rename(self, fs, path, data: bytes) -> bool:
        """The file is written beside its place, whole, and then renamed to it unless there is one by then."""
        jvm = self.spark._jvm
        staged = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(data))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, path, no_options)
            return True
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _put_on_condition(self, fs, path, data: bytes) -> bool:
        """An object store shows a file when it is closed, and refuses it then if there is one: by a conditional write
        that must be had. A store that knows no such write is refused, since two writers could both believe they won."""
        try:
            out = fs.createFile(path).overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            if any(x in f"{type(e).__name__} {e}" for x in ("IllegalArgument", "UnsupportedOperation")):
                raise EngineCapabilityError("the store has no conditional writes, which commits need", root=self.root) from e
            raise
        try:
            out.write(bytearray(data))
            out.close()
            return True
        except Exception as e:
            if any(x in str(e) for x in ("FileAlreadyExists", "PreconditionFailed", "412", "RemoteFileChanged")):
                return False
            raise

    def get(self, name: str) -> bytes:
        if self.local:
            return (self.local / name).read_bytes()
        fs, path = self._hadoop(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """The files of a folder, sorted; none if there is no such folder."""
        if self.local:
            d = self.local / folder
            return sorted(p.name for p in d.iterdir() if p.is_file() and not p.name.startswith(".")) if d.is_dir() else []
        fs, path = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(".")) if fs.exists(path) else []

    def delete(self, name: str) -> None:
        """Deletes a file or a folder with all in it, if it is there."""
        if self.local:
            p = self.local / name
            shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
            return
        fs, path = self._hadoop(name)
        fs.delete(path, True)
