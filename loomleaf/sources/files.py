"""Files as a sink: one file a row, each whole or not there at all.

``df.write.format("loomleaf_files").option("path", folder).mode("append").save()`` takes rows of
name and content.  Tasks write under a hidden folder of their own job; a commit moves each file to
its name in one step, an abort leaves no file (at most the hidden folder, by a task still at work).  The folder must be one that driver and
executors share.  A name that leads out of the folder is refused, as is writing over a file
that is there unless ``overwrite`` is "true".
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class FileNameRefused(ValueError):
    """A name that isn't one of a file in the folder."""


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str] = field(default_factory=list)
    staging: str = ""


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomleaf_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> WholeFilesWriter:
        return WholeFilesWriter(self.options["path"], overwrite or self.options.get("overwrite", "false").lower() == "true")


class WholeFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://").removeprefix("file:"), overwrite
        self.staging = os.path.join(self.path, f".partial-{uuid.uuid4().hex}")

    def write(self, rows) -> WrittenFiles:
        mine = os.path.join(self.staging, uuid.uuid4().hex)  # a task that is run again has a folder of its own
        os.makedirs(mine, exist_ok=True)
        out = WrittenFiles(staging=mine)
        for row in rows:
            name = row["name"]
            if not name or name.startswith((".", "/")) or "/" in name or "\\" in name or "\0" in name:
                raise FileNameRefused(f"{name!r} is no file name")
            if not self.overwrite and os.path.exists(os.path.join(self.path, name)):
                raise FileExistsError(name)
            with open(os.path.join(mine, name), "xb") as f:
                f.write(bytes(row["content"] or b""))
                f.flush()
                os.fsync(f.fileno())
            out.names.append(name)
        return out

    def commit(self, messages) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise FileExistsError("a name is written twice")
        for message in messages:
            for name in message.names if message else ():
                os.replace(os.path.join(message.staging, name), os.path.join(self.path, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WholeFiles)
