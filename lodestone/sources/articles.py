"""Article sources: JATS, OCR and LaTeX files cut into sections, and text cut into overlapping chunks. One file is one row."""

from __future__ import annotations

import gzip
import html
import io
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SECTIONS = "path string, section int, name string, text string, has_equation boolean, has_table boolean, error string"
# Markup that is not read, headings that end the text, shortest text that counts.
SKIPPED = frozenset([
    "table-wrap", "table", "fig", "graphic", "media", "disp-formula", "inline-formula", "tex-math", "math", "ref-list", "xref", "fn", "label",
    "caption",
])
BACK_MATTER = re.compile(r"(?im)^\s*(?:references|bibliography|acknowledge?ments?)\s*:?\s*$")
LEAST_CHARS = 200
PIECE = 4 << 20  # characters of chunks that leave a task at once


def _plain(node: ET.Element) -> str:
    parts = [node.text or ""]
    for child in node:
        tag = child.tag.rpartition("}")[2]
        if tag not in SKIPPED:
            parts.append(_plain(child))
            if tag in ("p", "title", "sec", "list-item"):
                parts.append(" ")
        parts.append(child.tail or "")
    return "".join(parts)


def jats_sections(raw: bytes) -> list[tuple[str, str, bool, bool]]:
    """(name, text, has equation, has table) of each top section of the body; a body without sections is one."""
    text = re.sub(r"<!DOCTYPE[^>]*>", "", raw.decode("utf-8", "replace"))
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w+);", lambda m: html.escape(html.unescape(m[0])), text)
    root = ET.fromstring(text)
    body = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "body"), None)
    if body is None:
        return []
    tops = [e for e in body if e.tag.rpartition("}")[2] == "sec"] or [body]
    out = []
    for sec in tops:
        tags = {e.tag.rpartition("}")[2] for e in sec.iter()}
        title = next((e for e in sec if e.tag.rpartition("}")[2] == "title"), None)
        name = " ".join(_plain(title).split()) if title is not None else "Body"
        said = " ".join(_plain(sec).split())
        if title is not None and said.startswith(name):
            said = said[len(name) :].strip()
        if said:
            out.append((name, said, bool(tags & {"disp-formula", "inline-formula", "math"}), bool(tags & {"table", "table-wrap"})))
    return out


def ocr_sections(raw: bytes) -> list[tuple[str, str, bool, bool]]:
    """Text of a scan: hyphens at line ends closed, page numbers and copyright lines dropped, cut at the back matter, parted at headings."""
    text = raw.decode("utf-8", "replace").replace("\r", "")
    end = BACK_MATTER.search(text)
    text = text[: end.start()] if end else text
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", text)
    lines = [x for x in text.split("\n") if not re.fullmatch(r"\s*\d{1,4}\s*", x) and not re.search(r"(?i)©|\(c\) \d{4}|copyright", x)]
    out, name, held = [], "Body", []

    def close():
        if said := " ".join(" ".join(held).split()):
            out.append((name, said, False, False))

    for line in lines:
        if re.fullmatch(r"\s*(?:[IVX]+|\d+)\.\s+[A-Z][A-Za-z ,\-]{2,60}\s*", line):
            close()
            name, held = line.strip(), []
        else:
            held.append(line)
    close()
    if sum(len(t) for _, t, _, _ in out) < LEAST_CHARS:
        raise ValueError("too short")
    return out


def _tex_files(raw: bytes) -> dict[str, str]:
    if raw[:4] == b"%PDF":
        raise ValueError("pdf")
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            return {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in tar if m.isfile() and m.name.endswith((".tex", ".ltx"))}
    except tarfile.ReadError:
        return {"main.tex": raw.decode("utf-8", "replace")}


def latex_sections(raw: bytes) -> list[tuple[str, str, bool, bool]]:
    """Sections of a LaTeX archive (tar, gzip or bare): inputs inlined, preamble, comments and bibliography dropped."""
    files = _tex_files(raw)
    main = max(files, key=lambda n: ("\\documentclass" in files[n], "\\begin{document}" in files[n], len(files[n])), default=None)
    if main is None:
        raise ValueError("no tex file")

    def inlined(name: str, above: tuple[str, ...]) -> str:
        def other(m: re.Match) -> str:
            want = m[1].strip()
            hit = next((f for f in (want, want + ".tex", f"./{want}.tex") if f in files), None)
            return inlined(hit, (*above, hit)) if hit and hit not in above else ""

        return re.sub(r"\\(?:input|include)\{([^}]*)\}", other, re.sub(r"(?<!\\)%.*", "", files[name]))

    text = inlined(main, (main,))
    text = text.split("\\begin{document}", 1)[-1].split("\\end{document}", 1)[0]
    text = re.split(r"\\begin\{thebibliography\}|\\bibliography\{", text, maxsplit=1)[0]
    parts = re.split(r"\\section\*?\{([^}]*)\}", text)
    out = []
    for name, body in [("Front", parts[0]), *zip(parts[1::2], parts[2::2])]:
        equation = bool(re.search(r"\\begin\{(?:equation|align|eqnarray)|\$\$|\\\[", body))
        table = "\\begin{tabular" in body
        said = re.sub(r"\\begin\{(equation|align|eqnarray|tabular|table|figure)\*?\}.*?\\end\{\1\*?\}", " ", body, flags=re.S)
        said = re.sub(r"\\(?:cite|ref|label|eqref)\w*\{[^}]*\}", "", said)
        said = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ", said)
        said = " ".join(re.sub(r"[{}~]", " ", said).split())
        if said:
            out.append((name, said, equation, table))
    return out


FORMATS = {"jats": jats_sections, "ocr": ocr_sections, "latex": latex_sections}


def read_articles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A row a section of every file; a file that can't be read gives one row with its error. Files are read by Spark, one at a time."""
    parse = FORMATS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path_, content in zip(part["path"], part["content"]):
                try:
                    rows += [(path_, k, *s, None) for k, s in enumerate(parse(content))]
                except (ET.ParseError, ValueError, EOFError, OSError) as e:
                    rows.append((path_, 0, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "section", "name", "text", "has_equation", "has_table", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SECTIONS)


def chunks(sections: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id", section: str = "name", text: str = "text") -> DataFrame:
    """(key, section, chunk, text, tokens): paragraphs packed greedily to `size` words, each chunk after the first led by the last
    `overlap` words of the one before; longer paragraphs are cut at sentence ends, longer sentences at `size` words."""

    def pieces(t: str) -> Iterator[list[str]]:
        for paragraph in re.split(r"\n\s*\n", t):
            words = paragraph.split()
            if len(words) <= size:
                if words:
                    yield words
                continue
            for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                w = sentence.split()
                for k in range(0, len(w), size):
                    yield w[k : k + size]

    def packed(t: str) -> Iterator[list[str]]:
        held: list[str] = []
        fresh = 0
        for p in pieces(t):
            if fresh and len(held) + len(p) > size:
                yield held
                held, fresh = held[-overlap:] if overlap else [], 0
                held = held[max(0, len(held) + len(p) - size) :]
            held = held + p
            fresh += len(p)
        if fresh:
            yield held

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections are taken out of their batch one by one, and chunks leave as soon as there are PIECE characters of them."""
        rows, held = [], 0
        for part in parts:
            for i in range(part.num_rows):
                k, s, t = (part.column(c)[i] for c in range(3))
                for c, w in enumerate(packed(t.as_py() or "")):
                    rows.append((k.as_py(), s.as_py(), c, " ".join(w), len(w)))
                    held += len(rows[-1][3]) + 100
                    if held >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    kind = sections.schema[key].dataType.simpleString()
    given = sections.select(F.col(key).alias("k"), F.col(section).alias("s"), F.col(text).alias("t"))
    schema = f"`{key}` {kind}, `{section}` string, chunk int, text string, tokens int"
    out = to_arrow_schema(sections.sparkSession.createDataFrame([], schema).schema)
    return given.mapInArrow(run, schema)


def batches(df: DataFrame, tokens: str, most: int = 14_000, rows: int = 250) -> DataFrame:
    """df with `batch`: rows packed in order to at most `most` tokens and `rows` rows within each partition; an oversize row is alone."""
    schema = df.withColumn("batch", F.lit("")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, held, count = 0, 0, 0
        where = TaskContext.get().partitionId()
        for part in parts:
            names = []
            for t in part[tokens]:
                if count and (held + t > most or count >= rows):
                    n, held, count = n + 1, 0, 0
                held, count = held + t, count + 1
                names.append(f"{where}-{n}")
            yield part.assign(batch=names)

    return df.mapInPandas(run, schema)
