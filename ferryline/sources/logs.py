"""Append-only logs of JSON lines: the small files of many entries, rolled into a few.

For a while an entry is in a small file and in a rolled one, so what reads a log
must give the same for a repeated line: states and commits take the newest,
`audit_log.read_errors` takes distinct lines.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ferryline.session import delete_path, files_in, one_row, path_exists

NOTES = "_rolled"  # names with an underscore in front are no rows to Spark
GRACE_SECONDS = 3600.0  # how long a reader that has listed a file may still want to open it
FEW = 32  # this many small files are left as they are
SMALL_BYTES = 64 * 1024 * 1024  # a file that has grown to this is not copied again


def roll_log(spark: SparkSession, path: str, few: int = FEW, grace: float = GRACE_SECONDS) -> int:
    """Copy the small files of a log into one, and delete those that were copied at least `grace` seconds ago; how many were copied.

    Readers and writers may go on meanwhile.  The lines are first written once
    more, as a file that appears as a whole; then a note says which files they
    came from; a later call deletes these and the note.  A call that dies in between leaves
    lines twice.  Lines appended meanwhile stay in files of their own.  One
    caller at a time for a log; a missing or empty log stays as it is.
    """
    if not path_exists(spark, path):
        return 0
    sizes = {name: size for name, size in files_in(spark, path).items() if not name.startswith(("_", "."))}
    copied: set[str] = set()
    for note, at, names in _notes(spark, f"{path}/{NOTES}"):
        if at + grace > time.time():
            copied |= set(names)
            continue
        for name in names:
            delete_path(spark, f"{path}/{name}")
            sizes.pop(name, None)
        delete_path(spark, f"{path}/{NOTES}/{note}")
    small = sorted(name for name, size in sizes.items() if name not in copied and size < SMALL_BYTES)
    if len(small) <= few:
        return 0
    lines = spark.read.text([f"{path}/{name}" for name in small]).distinct()
    lines.coalesce(1).write.mode("append").text(path)
    note = json.dumps({"at": time.time(), "names": small})
    one_row(spark, value=F.lit(note)).write.mode("append").text(f"{path}/{NOTES}")
    return len(small)


def _notes(spark: SparkSession, path: str) -> list[tuple[str, float, list[str]]]:
    """(file, time, names) of the notes not settled yet."""
    if not path_exists(spark, path):
        return []
    rows = spark.read.text(path).select("_metadata.file_name", "value").collect()
    return [(r[0], note["at"], note["names"]) for r in rows for note in [json.loads(r[1])]]
