"""Schedule export files: reading with encoding detection, tables, writing and a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical order of the tables in a file.
TABLE_ORDER = ["CURRTYPE", "FINTMPL", "OBS", "PROJECT", "CALENDAR", "SCHEDOPTIONS", "PROJWBS", "TASK", "TASKPRED", "TASKRSRC", "RSRC", "RSRCRATE", "ACTVTYPE", "ACTVCODE", "TASKACTV", "UDFTYPE", "UDFVALUE", "PROJPCAT", "PCATTYPE", "PCATVAL", "TASKFIN", "TRSRCFIN", "TASKDOC", "PROJDOCS", "ROLERATE", "ROLES", "RSRCROLE", "SHIFT", "SHIFTPER", "ACCOUNT", "RCATTYPE", "RCATVAL", "RSRCCAT", "MEMOTYPE", "TASKMEMO", "WBSMEMO", "PROJMEMO", "RISKTYPE", "RISK", "RISKTYPES"]
# Positional fields of the header.
HEADER = ["version", "export_date", "export_flag", "user", "user_full_name", "database", "module", "currency"]
_MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]

FILES = "file_id string, encoding string, error string, header map<string,string>, sha256 string, n_bytes long"
ROWS = "file_id string, tab string, ord int, fields array<string>, vals array<string>"


def marked_encoding(head: bytes) -> str | None:
    """Encoding that a byte-order mark names; the longer of two marks that begin alike."""
    return next((name for mark, name in _MARKS if head.startswith(mark)), None)


def decode(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """Text and the encoding that read it. A named encoding is the only one tried."""
    tried = [encoding] if encoding else [*filter(None, [marked_encoding(data[:4])]), "utf-8", "cp1252", "utf-16", "latin-1"]
    for name in tried:
        try:
            return data.decode(name).removeprefix("﻿"), name
        except UnicodeError:
            continue
    raise ValueError(f"no encoding of {tried} reads the file")


def read_text(text: str) -> tuple[dict[str, str], list[tuple[str, list[str], list[str]]]]:
    """Header fields, and (table, fields, values) of each record in order.

    Short records are filled up with ``''`` and surplus values dropped; records before a
    table and its fields are left out; other lines are ignored.
    """
    header: dict[str, str] = {}
    rows: list[tuple[str, list[str], list[str]]] = []
    tab, fields = "", []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        kind, *rest = line.split("\t")
        if kind == "ERMHDR":
            header = dict(zip(HEADER, rest, strict=False)) | {"raw": "\t".join(rest)}
        elif kind == "%T":
            tab, fields = (rest[0].strip() if rest else ""), []
        elif kind == "%F":
            fields = [f.strip() for f in rest]
        elif kind == "%R" and tab and fields:
            rows.append((tab, fields, (rest + [""] * len(fields))[: len(fields)]))
    return header, rows


def read_heads(text: str) -> dict[str, list[str]]:
    """The last field list of each table, of tables without records, too."""
    heads: dict[str, list[str]] = {}
    tab = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        kind, *rest = line.split("\t")
        if kind == "%T":
            tab = rest[0].strip() if rest else ""
            heads.setdefault(tab, [])
        elif kind == "%F" and tab:
            heads[tab] = [f.strip() for f in rest]
    return heads


def document(data: bytes, encoding: str | None = None) -> dict:
    """One file as a nested document: header, encoding, and per table its fields and records."""
    text, name = decode(data, encoding)
    header, rows = read_text(text)
    tables = {t: {"fields": f, "records": []} for t, f in read_heads(text).items() if t}
    for t, f, v in rows:
        tables[t]["records"].append(dict(zip(f, v, strict=True)))
    return {"ermhdr": header, "encoding_used": name, "tables": tables}


def document_text(doc: dict) -> str:
    """The text of a file from its document (see :func:`document`); a field that a record lacks is empty."""
    tables = {t: (x["fields"], [[r.get(f) for f in x["fields"]] for r in x["records"]]) for t, x in doc.get("tables", {}).items()}
    head = doc.get("ermhdr", {})
    return file_text(head.get("raw") or "\t".join(head.get(h, "") for h in HEADER) if head else None, tables)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One row per file: how it was decoded, its header and digest; an unreadable file has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text, name = decode(data, encoding)
                    header, err = read_text(text)[0], None
                except ValueError as e:
                    header, name, err = {}, None, str(e)
                out.append((p, name, err, header, hashlib.sha256(data).hexdigest(), len(data)))
            yield pd.DataFrame(out, columns=["file_id", "encoding", "error", "header", "sha256", "n_bytes"])

    return _binary(spark, path).mapInPandas(run, FILES)


def read_rows(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Every record of every table: file_id, tab, ord, fields, vals. One task reads a file,
    since a record's meaning hangs on the headers before it; unreadable files give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = read_text(decode(data, encoding)[0])[1]
                except ValueError:
                    continue
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame([(p, t, k + i, f, v) for i, (t, f, v) in enumerate(rows[k : k + 10_000])], columns=["file_id", "tab", "ord", "fields", "vals"])

    return _binary(spark, path).mapInPandas(run, ROWS)


def table(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One table with the given columns; a column that a file lacks, and an unknown table, read as ``''`` and empty."""
    at = lambda c: F.array_position("fields", F.lit(c)).cast("int")
    return rows.where(F.col("tab") == name).select("file_id", "ord", *[F.coalesce(F.when(at(c) > 0, F.get("vals", at(c) - 1)), F.lit("")).alias(c) for c in columns])


def fields(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """file_id, table, pos, field: the last field list of each table, of tables without records, too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    heads = read_heads(decode(data, encoding)[0])
                except ValueError:
                    continue
                out += [(p, t, i, f) for t, fs in heads.items() for i, f in enumerate(fs)]
            yield pd.DataFrame(out, columns=["file_id", "table", "pos", "field"])

    return _binary(spark, path).mapInPandas(run, "file_id string, table string, pos int, field string")


def table_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id", F.col("tab").alias("table")).agg(F.count(F.lit(1)).alias("n"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per file: encoding, digest, size, header, and the rows of each table."""
    counts = table_counts(read_rows(spark, path)).groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("tables"))
    return read_files(spark, path).join(counts, "file_id", "left")


def file_text(header: str | None, tables: dict[str, tuple[list[str], list[list[str | None]]]]) -> str:
    """A file's text: header, tables in canonical order, then the others; lines end with CRLF.

    Tables without fields are left out; a null value is empty; a record of the wrong width is
    an error.
    """
    head = header if header and header.count("\t") >= 4 else "\t".join(["24.12", "", "Project", "", "", "", "Project Management", "USD"])
    lines = [f"ERMHDR\t{head}"]
    for name in [*[t for t in TABLE_ORDER if t in tables], *[t for t in tables if t not in TABLE_ORDER]]:
        cols, rows = tables[name]
        if not cols:
            continue
        lines += [f"%T\t{name}", "\t".join(["%F", *cols])]
        for r in rows:
            if len(r) != len(cols):
                raise ValueError(f"{name}: {len(r)} values for {len(cols)} fields")
            lines.append("\t".join(["%R", *["" if v is None else str(v) for v in r]]))
    return "\r\n".join(lines) + "\r\n"


def write_files(rows: DataFrame, headers: DataFrame, folder: str) -> DataFrame:
    """Write one file per file_id; returns file_id, path, n_bytes, and runs when it is acted on.

    A file is one unit: its rows meet in the task that writes it, as the format demands. The
    executors write to ``folder`` themselves, so on a cluster it must be one that they and the
    reader share (a mounted volume), like the folder of ``spark.checkpoint.dir``.
    """
    meet = rows.join(headers.select("file_id", F.col("header")["raw"].alias("raw")), "file_id", "left")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        tables: dict[str, tuple[list[str], list]] = {}
        for t, f, v in pdf.sort_values("ord")[["tab", "fields", "vals"]].itertuples(index=False):
            cols = tables.setdefault(t, (list(f), []))
            cols[1].append(list(v))
        data = file_text(pdf["raw"].iloc[0], tables).encode()
        name = os.path.join(folder, os.path.basename(key[0]))
        with open(name, "wb") as out:
            out.write(data)
        return pd.DataFrame([(key[0], name, len(data))], columns=["file_id", "path", "n_bytes"])

    return meet.groupBy("file_id").applyInPandas(write, "file_id string, path string, n_bytes long")
