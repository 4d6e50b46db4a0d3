"""Helpers shared by the corpus operators: written stages, hot keys, local bindings inside one row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule in this folder: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than one row in this many; so there are fewer hot keys than this.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a scratch folder; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: later plans read each row once, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch handed to Python: texts are long, and both sides hold a batch as a whole.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of at most ARROW_ROWS rows that end once they hold ARROW_BYTES.

    Spark takes both bounds from the session; they bound memory and change no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str) -> DataFrame:
    """Inner join of rows with one row per key, where one key may hold a third of all rows.

    `count` holds the rows of each key. Keys over total / HOT_SHARE are fewer than HOT_SHARE, whatever the input's size, so that part is
    broadcast and its rows stay where they are; the other keys are small and are joined by a shuffle.
    """
    cut = total // HOT_SHARE
    hot = groups.where(F.col(count) > cut)
    cool = groups.where(F.col(count) <= cut)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key))


#: Bytes of a term stay (A-Z as a-z), all others are blanks: a term is a run of digits, letters of ASCII and bytes from 0x80 on.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TEXT_PART = 1 << 20


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about TEXT_PART bytes: a long text is cut between terms."""
    plain, at = text.translate(TERM_BYTES), 0
    while at < len(plain):
        stop = plain.find(b" ", at + TEXT_PART)
        stop = len(plain) if stop < 0 else stop
        yield plain[at:stop].split()
        at = stop


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute `value` once for a row and use it any number of times in `body`."""
    return F.transform(F.array(value), body)[0]
