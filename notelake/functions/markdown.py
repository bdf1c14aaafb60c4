"""Markdown scanning as one Arrow pass: sections, chunks, links and front matter of each note.

The scanner is a small helper for one text; Spark deals the texts out and explodes what it returns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import CHUNK

_BREAKS = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_CODE = re.compile(r"(`+)(?:(?!\1).)*?\1")
_INLINE = re.compile(r"(!?)\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*<?([^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)")
_WIKI = re.compile(r"(!?)\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]")


def lines_of(text: str) -> list[str]:
    """Lines at every Unicode break; one break at the end adds none."""
    lines = _BREAKS.split(text)
    return lines[:-1] if lines and lines[-1] == "" else lines


def uncoded(lines: list[str]) -> list[bool]:
    """For each line, whether it stands outside code fences; fences count as code."""
    out, fence = [], None
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            out.append(False)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(False)
        else:
            out.append(True)
    return out


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(first line, level, title) of ATX and setext headings outside code."""
    plain, out, used = uncoded(lines), [], -1
    for i, line in enumerate(lines):
        if not plain[i]:
            continue
        if m := _ATX.match(line):
            out.append((i, len(m[1]), (m[2] or "").strip()))
            used = i
        elif (m := _SETEXT.match(line)) and i - 1 > used and plain[i - 1] and lines[i - 1].strip() and not _ITEM.match(lines[i - 1]) and not lines[i - 1].lstrip().startswith((">", "|")):
            out.append((i - 1, 1 if m[1][0] == "=" else 2, lines[i - 1].strip()))
            used = i
    return out


def sections(text: str) -> list[tuple[list[str], int, list[str]]]:
    """(heading path, first line, lines): the text cut at headings, the lead with an empty path."""
    lines = lines_of(text)
    found = headings(lines)
    cuts = [(0, [])] if not found or found[0][0] > 0 else []
    stack: list[tuple[int, str]] = []
    for at, level, title in found:
        stack = [*[s for s in stack if s[0] < level], (level, title)]
        cuts.append((at, [t for _, t in stack]))
    out = []
    for (at, path), end in zip(cuts, [*[c[0] for c in cuts[1:]], len(lines)], strict=True):
        body = lines[at:end]
        while body and not body[-1].strip():
            body.pop()
        if body:
            out.append((path, at + 1, body))
    return out


def cut_chunks(body: list[str], limit: int = CHUNK) -> list[tuple[int, list[str]]]:
    """(offset, lines) of a section's chunks: whole if short, else cut at blank lines, then before list items."""
    if len("\n".join(body)) <= limit:
        return [(0, body)]
    plain = uncoded(body)
    blocks: list[tuple[int, list[str]]] = []
    for i, line in enumerate(body):
        blank_before = i > 0 and not body[i - 1].strip() and plain[i]
        if not blocks or (blank_before and line.strip()):
            blocks.append((i, [line]))
        else:
            blocks[-1][1].append(line)
    parts: list[tuple[int, list[str]]] = []
    for at, block in blocks:
        if len("\n".join(block)) <= limit:
            parts.append((at, block))
            continue
        for k, line in enumerate(block):
            if k == 0 or (_ITEM.match(line) and plain[at + k]):
                parts.append((at + k, [line]))
            else:
                parts[-1][1].append(line)
    out: list[tuple[int, list[str]]] = []
    for at, part in parts:
        joined = [*out[-1][1], *part] if out else part
        if out and (len("\n".join(joined)) <= limit or (len(out) == 1 and len(out[0][1]) <= 2 and _ATX.match(out[0][1][0]))):
            out[-1] = (out[-1][0], joined)
        else:
            out.append((at, part))
    return out


def links(text: str) -> list[tuple[str, bool]]:
    """(target, is wiki name) of links outside code; images and embeds are left out."""
    lines = lines_of(text)
    out = []
    for line, plain in zip(lines, uncoded(lines), strict=True):
        if plain:
            line = _CODE.sub("", line)
            out += [(m[2], False) for m in _INLINE.finditer(line) if not m[1]]
            out += [(m[2].strip(), True) for m in _WIKI.finditer(line) if not m[1]]
    return out


def split_frontmatter(text: str) -> tuple[str | None, str, int]:
    """(front matter, body, lines before the body); None without a closed block at the start."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[0].rstrip() == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip() == "---":
                return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :]), i + 1
    return None, text, 0


_CHUNKS = pa.list_(pa.struct([("heading_path", pa.list_(pa.string())), ("ordinal", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())]))
_LINKS = pa.list_(pa.struct([("target", pa.string()), ("is_name", pa.bool_())]))


def _scan(batches):
    for batch in batches:
        chunk_rows, link_rows = [], []
        for text in batch.column(1).to_pylist():
            made = []
            for path, first, body in sections(text or ""):
                for ordinal, (at, part) in enumerate(cut_chunks(body)):
                    while part and not part[-1].strip():
                        part = part[:-1]
                    made.append({"heading_path": path, "ordinal": ordinal, "start_line": first + at, "end_line": first + at + len(part) - 1, "text": "\n".join(part)})
            chunk_rows.append(made)
            link_rows.append([{"target": t, "is_name": n} for t, n in links(text or "")])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunk_rows, _CHUNKS), pa.array(link_rows, _LINKS)], names=["owner", "chunks", "links"])


def scan_notes(notes: DataFrame, key: str, body: str) -> DataFrame:
    """``(owner, chunks, links)`` of each note in one pass."""
    kind = notes.schema[key].dataType.simpleString()
    chunk = "array<struct<heading_path: array<string>, ordinal: int, start_line: int, end_line: int, text: string>>"
    return notes.select(F.col(key), F.col(body).cast("string")).mapInArrow(_scan, f"owner {kind}, chunks {chunk}, links array<struct<target: string, is_name: boolean>>")


def chunk_documents(notes: DataFrame, key: str = "concept_id", body: str = "body") -> DataFrame:
    """One row per chunk, with its key: SHA-256 of owner, heading path, ordinal and text hash."""
    each = scan_notes(notes, key, body).select("owner", F.explode("chunks").alias("c")).select("owner", "c.*")
    parts = [F.col("owner").cast("string"), F.array_join("heading_path", "\x1e"), F.col("ordinal").cast("string"), F.sha2("text", 256)]
    return each.withColumn("chunk_key", F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\x1f"))]), 256))
