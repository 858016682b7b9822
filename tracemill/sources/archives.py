"""Archive sources: zip and tar files read by binaryFile and unpacked in Arrow batches, one row per entry.

Every entry gives a row; `reason` says why an entry was not read. Entries of one archive are read one after the
other, and only accepted contents are kept.
"""

from __future__ import annotations

import io
import tarfile
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ENTRY = "archive string, path string, bytes bigint, content binary, reason string"
MOST_ENTRIES = 1000
MOST_ENTRY_BYTES = 100_000
MOST_EXPANDED = 10_000_000
MOST_RATIO = 100


def unsafe(path: str) -> bool:
    """Whether a path could leave the archive or is not plain."""
    if not path or len(path) > 512 or path != unicodedata.normalize("NFC", path) or path.startswith("/"):
        return True
    if any(c in path for c in "\\:%") or any(ord(c) < 32 or ord(c) == 127 for c in path):
        return True
    return any(s in ("", ".", "..") for s in path.rstrip("/").split("/"))


def zip_entries(data: bytes, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_ENTRY_BYTES, most_total: int = MOST_EXPANDED) -> list[tuple]:
    """(path, bytes, content, reason) of a zip archive; a broken archive is one row with the reason."""
    if data[:4] not in (b"PK\x03\x04", b"PK\x05\x06"):
        return [(None, len(data), None, "not_a_zip")]
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return [(None, len(data), None, "invalid_zip")]
    infos = archive.infolist()
    if len(infos) > most_entries:
        return [(None, len(data), None, "too_many_entries")]
    spans = sorted((i.header_offset, i.header_offset + 30 + len(i.filename) + i.compress_size) for i in infos)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        return [(None, len(data), None, "overlapping_entries")]
    out, total, seen = [], 0, set()
    for i in infos:
        kind = (i.external_attr >> 16) & 0o170000
        reason = None
        if i.is_dir():
            continue
        if unsafe(i.filename):
            reason = "unsafe_path"
        elif i.filename in seen:
            reason = "duplicate_path"
        elif kind not in (0, 0o100000):
            reason = "special_file"
        elif i.flag_bits & 1:
            reason = "encrypted"
        elif i.file_size > most_bytes:
            reason = "file_too_large"
        elif i.compress_size and i.file_size / i.compress_size > MOST_RATIO:
            reason = "compression_ratio"
        elif total + i.file_size > most_total:
            reason = "expanded_too_large"
        seen.add(i.filename)
        content = None
        if reason is None:
            try:
                content = archive.read(i)
                total += len(content)
                content.decode("utf-8")
                if b"\0" in content:
                    content, reason = None, "binary"
            except UnicodeDecodeError:
                content, reason = None, "not_utf8"
            except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, ValueError):
                reason = "corrupt_entry"
        out.append((i.filename, i.file_size, content, reason))
    return out


def tar_entries(data: bytes, most_bytes: int = MOST_ENTRY_BYTES) -> list[tuple]:
    """(path, bytes, content, reason) of a tar or tar.gz archive: regular files with the single root taken off."""
    try:
        archive = tarfile.open(fileobj=io.BytesIO(data))
        members = archive.getmembers()
    except (tarfile.TarError, EOFError, OSError):
        return [(None, len(data), None, "invalid_tar")]
    out = []
    for m in members:
        if m.isdir():
            continue
        path = m.name.split("/", 1)[1] if "/" in m.name else m.name
        if not m.isfile():
            out.append((path, m.size, None, "special_file"))
        elif unsafe(path):
            out.append((path, m.size, None, "unsafe_path"))
        elif m.size > most_bytes:
            out.append((path, m.size, None, "file_too_large"))
        else:
            out.append((path, m.size, archive.extractfile(m).read(), None))
    return out


def read_archives(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries of all archives below a path; kind is zip or tar."""
    reader = {"zip": zip_entries, "tar": tar_entries}[kind]

    def run(frames):
        for frame in frames:
            rows = [(name, *entry) for name, content in zip(frame["path"], frame["content"]) for entry in reader(bytes(content))]
            yield pd.DataFrame(rows, columns=["archive", "path", "bytes", "content", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ENTRY)
