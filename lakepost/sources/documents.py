"""Sources of attachments: type detection, guarded ZIP reading, office text, segments with budgets."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lakepost.functions.text import decode_bytes, flatten_html, normalise, take_units

# Limits on archives and texts.
MAX_ENTRIES, MAX_EXPANDED, MAX_RATIO, MAX_CHARS = 4096, 100 * 1024 * 1024, 1000, 2_000_000
# Media types by extension.
TYPES = {
    "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "zip": "application/zip",
}
SEGMENT_SCHEMA = "document_key string, ordinal int, page_number int, slide_number int, sheet_name string, heading string, raw_text string, clean_text string, error string"


def zip_names(data: bytes) -> list[str] | None:
    """Names in the central directory, at most MAX_ENTRIES; null if there is none."""
    at = data.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(data):
        return None
    count, size, start = struct.unpack("<HII", data[at + 10 : at + 20])
    names, p = [], start
    while len(names) < min(count, MAX_ENTRIES) and p + 46 <= len(data) and data[p : p + 4] == b"PK\x01\x02":
        n, e, c = struct.unpack("<HHH", data[p + 28 : p + 34])
        names.append(data[p + 46 : p + 46 + n].decode("utf-8", errors="replace"))
        p += 46 + n + e + c
    return names


def detect_type(filename: str | None, declared: str | None, data: bytes | None) -> str:
    """Magic bytes, then an HTML look, then the extension, then what was declared."""
    b = bytes(data or b"")
    if b.startswith(b"%PDF-"):
        return TYPES["pdf"]
    if b.startswith(b"\x89PNG"):
        return TYPES["png"]
    if b.startswith(b"\xff\xd8\xff"):
        return TYPES["jpg"]
    if b.startswith(b"PK\x03\x04"):
        for part, ext in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(x.startswith(part) for x in zip_names(b) or []):
                return TYPES[ext]
        return TYPES["zip"]
    if re.match(rb"\s*(?:<!doctype html|<html)", b[:512], re.I):
        return TYPES["html"]
    ext = (filename or "").rpartition(".")[2].lower()
    return TYPES.get(ext) or (declared or "application/octet-stream").split(";")[0].strip().lower()


def open_archive(data: bytes) -> zipfile.ZipFile:
    """A ZIP within the limits on entries, size and ratio and without paths that lead out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES:
        raise ValueError("too many entries")
    total = 0
    for i in infos:
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename[:3]:
            raise ValueError("unsafe path")
        total += i.file_size
        if total > MAX_EXPANDED or i.compress_size and i.file_size / i.compress_size > MAX_RATIO:
            raise ValueError("expands too much")
    return z


def _texts(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}" + tag))


def _docx(z: zipfile.ZipFile) -> list[dict]:
    rows, heading = [], None
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:document|header\d*|footer\d*)\.xml", n)):
        lines = []
        for p in ElementTree.fromstring(z.read(part)).iter():
            if p.tag.endswith("}p"):
                style = next((v for s in p.iter() if s.tag.endswith("}pStyle") for v in s.attrib.values()), "")
                text = _texts(p, "t")
                if style.startswith("Heading") and text:
                    heading = heading or text
                if text:
                    lines.append(text)
        if lines:
            rows.append({"heading": heading, "raw_text": "\n".join(lines)})
    return rows


def _xlsx(z: zipfile.ZipFile) -> list[dict]:
    shared = [_texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    rels = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    rows = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if not s.tag.endswith("}sheet"):
            continue
        target = rels.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in z.namelist():
            continue
        lines = []
        for r in ElementTree.fromstring(z.read(path)).iter():
            if r.tag.endswith("}row"):
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c if x.tag.endswith("}v")), "")
                    v = shared[int(v)] if c.attrib.get("t") == "s" and v.isdigit() and int(v) < len(shared) else _texts(c, "t") if c.attrib.get("t") == "inlineStr" else v
                    if v:
                        cells.append(f"{c.attrib.get('r', '')}: {v}")
                if cells:
                    lines.append(" | ".join(cells))
        rows.append({"sheet_name": s.attrib.get("name"), "raw_text": "\n".join(lines)})
    return rows


def _pptx(z: zipfile.ZipFile) -> list[dict]:
    number = lambda n: int(re.findall(r"\d+", n)[-1])
    rows = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        texts = [_texts(p, "t") for p in ElementTree.fromstring(z.read(n)).iter() if p.tag.endswith("}p")]
        notes = f"ppt/notesSlides/notesSlide{number(n)}.xml"
        if notes in z.namelist():
            texts += [_texts(p, "t") for p in ElementTree.fromstring(z.read(notes)).iter() if p.tag.endswith("}p")]
        rows.append({"slide_number": number(n), "raw_text": "\n".join(t for t in texts if t)})
    return rows


def extract(filename: str | None, declared: str | None, data: bytes | None) -> list[dict]:
    """Segments of one file; an unknown type or a broken file gives one row with an error."""
    kind = detect_type(filename, declared, data)
    try:
        if kind in (TYPES["docx"], TYPES["xlsx"], TYPES["pptx"]):
            with open_archive(bytes(data or b"")) as z:
                rows = {TYPES["docx"]: _docx, TYPES["xlsx"]: _xlsx, TYPES["pptx"]: _pptx}[kind](z)
        elif kind == TYPES["html"]:
            rows = [{"raw_text": flatten_html(decode_bytes(data))}]
        elif kind.startswith("text/") or kind in (TYPES["json"], TYPES["xml"]):
            rows = [{"raw_text": decode_bytes(data)}]
        else:
            return [{"error": "unsupported-type"}]
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [{"error": f"{type(e).__name__}: {e}"[:500]}]
    return budget(rows)


def budget(rows: list[dict], limit: int = MAX_CHARS) -> list[dict]:
    """Non-empty segments in order until the character budget is used; two characters between segments count."""
    out, used = [], 0
    for r in rows:
        clean = normalise(r.get("raw_text"))
        left = limit - used - (2 if out else 0)
        if not clean or left <= 0:
            continue
        clean = take_units(clean, left)
        used += len(clean.encode("utf-16-le")) // 2 + (2 if out else 0)
        out.append(r | {"clean_text": clean, "raw_text": take_units(r["raw_text"], limit)})
    return out


def extract_segments(files: DataFrame, key: str = "document_key") -> DataFrame:
    """Segments of files (key, filename, mime_type, content); one row of a file at a time."""
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"document_key": k, "ordinal": i, **r} for k, f, m, c in zip(pdf[key], pdf["filename"], pdf["mime_type"], pdf["content"]) for i, r in enumerate(extract(f, m, c))]
            out = pd.DataFrame(rows, columns=names)
            out = out.astype(object).where(out.notna(), None)
            for c in ("ordinal", "page_number", "slide_number"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select(key, "filename", "mime_type", "content").mapInPandas(run, SEGMENT_SCHEMA)
