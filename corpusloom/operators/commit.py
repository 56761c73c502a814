"""One small file that says which version of a table is current, replaced by a rename."""

from __future__ import annotations

import json
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Pointer:
    """<path>/CURRENT, a line of JSON. Readers see the old or the new one, never a part."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark = path, spark
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at().getFileSystem(self._conf)

    def at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.at(*parts))

    def delete(self) -> None:
        self._fs.delete(self.at(), True)

    def read(self) -> dict | None:
        """What is current; None if nothing is, or if the file is damaged: then all is made anew."""
        if not self.exists("CURRENT"):
            return None
        stream = self._fs.open(self.at("CURRENT"))
        try:
            out = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except (Py4JJavaError, ValueError):
            return None
        finally:
            stream.close()
        return out if isinstance(out, dict) else None

    def swap(self, current: dict) -> None:
        new = self.at(f"CURRENT.{os.getpid()}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(current, sort_keys=True).encode()))
        out.close()
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(new, self.at("CURRENT"), how)
