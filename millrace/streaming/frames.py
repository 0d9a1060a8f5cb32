"""Events framed as lines (`event:`, `data:`, a blank line), from files and from pieces that were cut anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .keys import named, unnamed

FRAMES = "source string, n long, event string, data string"


def _field(frame: Column, name: str) -> Column:
    """Values of all lines of a field, one space behind the colon left out; a line without a colon is an empty value."""
    lines = F.split(frame, "\r\n|\n|\r")
    mine = F.filter(lines, lambda x: (x == name) | x.startswith(f"{name}:"))
    return F.transform(mine, lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))


def parsed(frame: Column) -> Column:
    """struct(event, data): the last `event`, by default `message`, and the `data` lines joined; data is null if there are none."""
    events, data = _field(frame, "event"), _field(frame, "data")
    event = F.coalesce(F.nullif(F.element_at(F.filter(events, lambda x: x.isNotNull()), F.lit(-1)), F.lit("")), F.lit("message"))
    return F.struct(F.when(F.size(events) > 0, event).otherwise("message").alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))


def framed(event: Column, data: Column) -> Column:
    """The frame of an event, without its closing blank line: every line of the data is a line of its own."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"))


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(event, data) of files of frames with plain line ends, as a table or a stream; frames without data are left out.

    A frame ends at a blank line, which the text source takes as the end of a record, so frames across the borders of
    splits are put together by the reader itself.
    """
    reader = spark.readStream if stream else spark.read
    rows = reader.option("lineSep", "\n\n").text(path).select(parsed(F.col("value")).alias("f")).select("f.*")
    return rows.where("data is not null")


def write_frames(events: DataFrame, path: str) -> None:
    """events (event, data) as files of frames that read_frames gives back."""
    events.select(framed(F.col("event"), F.col("data")).alias("value")).write.option("lineSep", "\n\n").text(path)


class Cutter:
    """Frames of one source from its pieces: what stands behind the last blank line waits for the next piece."""

    def __init__(self, rest: str = "", n: int = 0):
        self.rest, self.n = rest, n

    def feed(self, piece: str) -> list[tuple[int, str]]:
        # a line end may be cut in two, so a closing carriage return waits as well
        text = self.rest + piece
        held = text.endswith("\r")
        text = (text[:-1] if held else text).replace("\r\n", "\n").replace("\r", "\n")
        *whole, rest = text.split("\n\n")
        self.rest = rest + ("\r" if held else "")
        out = [(self.n + i, frame) for i, frame in enumerate(whole)]
        self.n += len(whole)
        return out


def joined(pieces: DataFrame) -> DataFrame:
    """(source, n, event, data) of pieces (source, seq, piece) of text, cut anywhere, in the order of seq; n counts a source's frames.

    Frames without data and a last one without a blank line are left out; null pieces are empty ones. Sorted pieces run
    through a task, which holds the open frame alone.
    """
    rows = pieces.select("source", "seq", F.coalesce("piece", F.lit("")).alias("piece")).repartition("source").sortWithinPartitions("source", "seq")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cutter = None, Cutter()
        for frame in frames:
            out = []
            for source, piece in zip(frame["source"], frame["piece"]):
                if at is None or source != at[0]:
                    at, cutter = (source,), Cutter()
                out += [(source, n, f) for n, f in cutter.feed(piece)]
            yield pd.DataFrame(out, columns=["source", "n", "frame"])

    return _told(rows.mapInPandas(cut, "source string, n long, frame string"))


def _told(frames: DataFrame) -> DataFrame:
    return frames.select("source", "n", parsed(F.col("frame")).alias("f")).select("source", "n", "f.event", "f.data").where("data is not null")


class Joining(StatefulProcessor):
    """The open frame of a source and the number of its frames in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "rest string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cutter, out = Cutter(*(self.open.get() or ("", 0))), []
        for piece in pd.concat(list(rows)).sort_values("seq", kind="stable")["piece"]:
            out += [(key[0], n, f) for n, f in cutter.feed(piece or "")]
        self.open.update((cutter.rest, cutter.n))
        yield pd.DataFrame(out, columns=["source", "n", "frame"])

    def close(self) -> None:
        pass


def joined_stream(pieces: DataFrame) -> DataFrame:
    """The same from a stream of pieces; those of a source must reach it in order."""
    rows = pieces.select(named(F.col("source")).alias("source"), "seq", "piece").groupBy("source")
    out = rows.transformWithStateInPandas(statefulProcessor=Joining(), outputStructType="source string, n long, frame string", outputMode="Append", timeMode="None")
    return _told(out.withColumn("source", unnamed(F.col("source"), "string")))
