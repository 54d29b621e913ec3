"""Small files and folders in any store that Spark reaches, handled from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """What is below one folder; names are given relative to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._options = spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._hadoop.Path(self.folder).getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(
            self._files.makeQualified(self._hadoop.Path(self.folder)).toUri(), conf
        )

    def _path(self, name: str):
        path = self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)
        return self._files.makeQualified(path)

    def address(self) -> str:
        """The folder as Spark writes it in front of its files' names."""
        return self._path("").toString()

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._path(name))

    def make_folder(self, name: str = "") -> None:
        self._files.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)

    def rename_new(self, name: str, new: str) -> bool:
        """Give a file or folder a name that nothing has; false if something has it."""
        try:
            self._context.rename(self._path(name), self._path(new), self._options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def write_new(self, name: str, text: str) -> bool:
        """A file with this text, whole or not at all; false if there is one of that name."""
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/_{uuid.uuid4().hex}_{last}".lstrip("/")
        out = self._files.create(self._path(hidden))
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if self.rename_new(hidden, name):
            return True
        self.delete(hidden)
        return False
