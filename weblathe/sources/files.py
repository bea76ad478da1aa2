"""A mirror's documents as files: written and deleted by tasks, a file's bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of a mirror's own tables.
STATE = ".state"


def _inside(name: str) -> bool:
    """Whether a file name stays in the mirror and out of its tables."""
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and ".." not in parts and parts[0] != STATE


def _at(mirror: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(mirror) if "://" in mirror else (fs.LocalFileSystem(), mirror)


def write_files(documents: DataFrame, mirror: str) -> DataFrame:
    """(filename, bytes) of documents(filename, content) that were written; -1 where the name leads out of the mirror. The mirror has to be a place that all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = _at(mirror)
        for batch in batches:
            sizes = []
            for name, content in zip(batch["filename"], batch["content"]):
                if not _inside(name):
                    sizes.append(-1)
                    continue
                path = f"{root.rstrip('/')}/{name}"
                place.create_dir(path.rpartition("/")[0], recursive=True)
                with place.open_output_stream(path) as f:
                    f.write(content or b"")
                sizes.append(len(content or b""))
            yield pd.DataFrame({"filename": batch["filename"], "bytes": sizes})

    return documents.select("filename", "content").mapInPandas(run, "filename string, bytes long")


def delete_files(names: DataFrame, mirror: str) -> DataFrame:
    """(filename, gone) of names(filename): deletes them, and folders that are empty then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = _at(mirror)
        root = root.rstrip("/")
        for batch in batches:
            gone = []
            for name in batch["filename"]:
                path = f"{root}/{name}"
                there = _inside(name) and place.get_file_info(path).type == fs.FileType.File
                gone.append(there)
                if there:
                    place.delete_file(path)
                    above = path.rpartition("/")[0]
                    while above != root and not place.get_file_info(fs.FileSelector(above, allow_not_found=True)):
                        try:
                            place.delete_dir(above)
                        except OSError:  # another task was faster, or has put a file there
                            break
                        above = above.rpartition("/")[0]
            yield pd.DataFrame({"filename": batch["filename"], "gone": gone})

    return names.select(F.col("filename")).mapInPandas(run, "filename string, gone boolean")


def write_parts(lines: DataFrame, mirror: str, folder: str) -> DataFrame:
    """(range, bytes) of lines(range, text), which lie in partitions by range and in order: each partition is written as a file of folder, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = _at(mirror)
        out, size, number = None, 0, None
        for batch in batches:
            if out is None and len(batch):
                number = int(batch["range"].iloc[0])
                place.create_dir(f"{root.rstrip('/')}/{folder}", recursive=True)
                out = place.open_output_stream(f"{root.rstrip('/')}/{folder}/{number}")
            data = "".join(batch["text"]).encode()
            size += len(data)
            if data:
                out.write(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"range": [number], "bytes": [size]})

    return lines.mapInPandas(run, "range int, bytes long")


def compose(parts: DataFrame, mirror: str, folder: str, name: str) -> int:
    """Puts the files of parts(range) one after another, in order of range, into a file of the mirror; a piece of them is in memory at a time. The parts go. Returns the bytes."""

    numbers = sorted(r["range"] for r in parts.collect())  # a row a range

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = _at(mirror)
        root, size = root.rstrip("/"), 0
        for _ in batches:
            with place.open_output_stream(f"{root}/{name}") as out:
                for number in numbers:
                    with place.open_input_stream(f"{root}/{folder}/{number}") as part:
                        while piece := part.read(1 << 20):
                            out.write(piece)
                            size += len(piece)
            yield pd.DataFrame({"bytes": [size]})

    found = parts.sparkSession.range(1, numPartitions=1).mapInPandas(run, "bytes long").collect()
    place, root = _at(mirror)
    if place.get_file_info(f"{root.rstrip('/')}/{folder}").type == fs.FileType.Directory:
        place.delete_dir(f"{root.rstrip('/')}/{folder}")
    return found[0]["bytes"]
