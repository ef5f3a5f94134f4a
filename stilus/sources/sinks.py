"""Writers.

Tables of any size are written by Spark. A single file with a byte order mark,
a fixed layout or captions is for small results: those stream through the
driver row by row.
"""

from __future__ import annotations

import csv
import gzip
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.functions import text as tx


def table(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """A table as CSV, JSON lines or gzip JSON lines, in as many files as it has partitions.

    CSV cells keep the white space at their ends.
    """
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.json(path, compression="gzip" if kind == "json.gz" else "none")


def csv_file(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """One CSV file with a byte order mark and a header; ``quote_all``: every cell quoted."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL)
        out.writerow(df.columns)
        out.writerows(tuple(r) for r in df.toLocalIterator())


def json_file(value, path: str) -> None:
    """An indented document in UTF-8 with a final newline."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def gzip_json_file(value, path: str) -> None:
    """A compact document, compressed without a time stamp, so that equal values give equal bytes."""
    Path(path).write_bytes(gzip.compress(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode(), mtime=0))


def json_lines_file(df: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for r in df.toLocalIterator():
            f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")


def once(df: DataFrame, path: str) -> bool:
    """Keep a first copy: write ``df`` unless something is there; whether it was written."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
    return True


def matrix_wide(matrix: DataFrame, names: list[str]) -> DataFrame:
    """sample, era and a column for each feature in the given order."""
    wide = matrix.groupBy("sample", F.col("group").alias("era")).pivot("feature", names).agg(F.first("freq"))
    return wide.orderBy("era", "sample")


def matrix_file(matrix: DataFrame, names: list[str], path: str) -> None:
    csv_file(matrix_wide(matrix, names), path, quote_all=True)


def caption_blocks(captions: DataFrame) -> DataFrame:
    """n, vtt, srt, ass: each caption (n from 1, start, end, text) as a block of each format."""
    start, end = F.col("start"), F.col("end")
    block = lambda mark: F.concat_ws("\n", F.col("n").cast("string"), F.concat(tx.timestamp(start, mark), F.lit(" --> "), tx.timestamp(end, mark)), "text", F.lit(""))
    ass = F.concat(F.lit("Dialogue: 0,"), tx.ass_timestamp(start), F.lit(","), tx.ass_timestamp(end), F.lit(",English,,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    return captions.select("n", block(".").alias("vtt"), block(",").alias("srt"), ass.alias("ass"))


def caption_files(captions: DataFrame, stem: str, ass_header: str = "") -> None:
    rows = caption_blocks(captions).orderBy("n").collect()
    Path(f"{stem}.vtt").write_text("\n".join(["WEBVTT\n", *(r.vtt for r in rows)]), encoding="utf-8")
    Path(f"{stem}.srt").write_text("\n".join(r.srt for r in rows), encoding="utf-8")
    if any(c in r.ass for r in rows for c in "{}"):
        raise ValueError("captions must not hold braces")
    Path(f"{stem}.ass").write_text(ass_header + "".join(r.ass + "\n" for r in rows), encoding="utf-8")
