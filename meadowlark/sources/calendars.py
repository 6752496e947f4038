"""A sink of calendar files: one iCalendar file for each venue, source or other key, written by tasks and committed by
the driver, so that a job that fails leaves nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archive import file_system
from .sinks import ical_event

FORMAT = "calendars"
BEGIN, END = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n", "END:VCALENDAR\r\n"


@dataclass
class Written(WriterCommitMessage):
    """Of one task: file of the attempt, name of the calendar."""

    files: list[tuple[str, str]]


class CalendarWriter(DataSourceWriter):
    """Each attempt of a task writes files of its own in a folder of the job; the driver moves those of the attempts
    that counted to their names, and deletes the folder. Where a job fails while others of its tasks still run, these may
    leave the folder behind, but never a calendar. Rows of a key stand together, in the calendar's order."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, folder = file_system(self.job)
        context = TaskContext.get()
        attempt = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(attempt, recursive=True)
        files: list[tuple[str, str]] = []
        seen: set[str] = set()
        out, now = None, None
        try:
            for row in iterator:
                if out is None or row["key"] != now:
                    if out is not None:
                        out.write(END.encode())
                        out.close()
                    now = row["key"]
                    if now in seen:
                        raise ValueError("rows of a calendar must stand together")
                    seen.add(now)
                    files.append((f"{attempt}/{len(files)}", f"{quote(now, safe='')}.ics"))
                    out = fs.open_output_stream(files[-1][0])
                    out.write(BEGIN.encode())
                out.write((row["text"] + "\r\n").encode())
            if out is not None:
                out.write(END.encode())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = file_system(self.path)
        moves = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote the same calendar")
        for source, name in moves:
            fs.move(source, f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, folder = file_system(self.job)
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class Calendars(DataSource):
    """Columns key and text (one VEVENT); option path: a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CalendarWriter:
        if [f.name for f in schema.fields] != ["key", "text"]:
            raise ValueError("calendars are written from the columns key and text")
        return CalendarWriter(self.options["path"])


def write_calendars(events: DataFrame, path: str, key: str = "venue_id") -> None:
    """A file `<key>.ics` for each value of a column (null: none), of all events with their venue's name, in order of
    start and id. A calendar is one task's; a task writes as it reads and holds one event at a time."""
    events.sparkSession.dataSource.register(Calendars)
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), ical_event().alias("text"), "date_start", "id")
    rows = rows.repartition("key").sortWithinPartitions("key", "date_start", "id").select("key", "text")
    rows.write.format(FORMAT).mode("append").option("path", path).save()
