"""Word documents with the standard library; PDF text where a library for it is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the namespace of word processing markup.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PART = "word/document.xml"


def docx_paragraphs(data: bytes) -> list[list[str]]:
    """Runs of every body paragraph (no tables or headers)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read(_PART)).find(f"{_W}body")
    return [["".join(t.text or "" for t in r.iter(f"{_W}t")) for r in p.iter(f"{_W}r")] for p in body.findall(f"{_W}p")]


def replace_in_runs(runs: Sequence[str], old: str, new: str) -> list[str]:
    """The first occurrence of ``old`` over the joined runs replaced: the run where it begins gets ``new``,
    the others lose their part of it."""
    at = "".join(runs).find(old) if old else -1
    if at < 0:
        return list(runs)
    end, out, place = at + len(old), [], 0
    for run in runs:
        a, b = max(at - place, 0), min(end - place, len(run))
        if a < b:
            out.append(run[:a] + (new if at >= place else "") + run[b:])
        else:
            out.append(run)
        place += len(run)
    return out


def redact_docx(data: bytes, spans: Sequence[tuple[str, str]]) -> bytes:
    """(surface, placeholder) pairs replaced once in every paragraph; all other parts are kept."""
    ElementTree.register_namespace("w", _W[1:-1])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {i: z.read(i.filename) for i in z.infolist()}
        root = ElementTree.fromstring(z.read(_PART))
    for p in root.find(f"{_W}body").findall(f"{_W}p"):
        runs = list(p.iter(f"{_W}r"))
        texts = ["".join(t.text or "" for t in r.iter(f"{_W}t")) for r in runs]
        done = texts
        for old, new in spans:
            done = replace_in_runs(done, old, new)
        for run, before, after in zip(runs, texts, done, strict=True):
            if before != after:
                for k, t in enumerate(run.iter(f"{_W}t")):
                    t.text = after if k == 0 else ""
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, raw in parts.items():
            z.writestr(info, ElementTree.tostring(root, encoding="utf-8", xml_declaration=True) if info.filename == _PART else raw)
    return out.getvalue()


def pdf_text(data: bytes) -> str | None:
    """Page texts joined by line ends; null without a PDF library or on a damaged file."""
    try:
        import fitz
    except ImportError:
        return None
    try:
        with fitz.open(stream=data, filetype="pdf") as pdf:
            return "\n".join(page.get_text() for page in pdf)
    except (RuntimeError, ValueError):
        return None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of Word and PDF files; null text where it can't be read."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                if name.lower().endswith(".docx"):
                    try:
                        texts.append("\n".join("".join(runs) for runs in docx_paragraphs(bytes(data))))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                        texts.append(None)
                else:
                    texts.append(pdf_text(bytes(data)))
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, "path string, text string")
