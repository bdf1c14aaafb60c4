"""Removal of byte strings that occur twice, by suffix sorting of aligned blocks.

A 200-byte window is named by its anchor: the window's ``GRAM``-byte run with the smallest
fingerprint. Equal windows have equal anchors at equal offsets, wherever they stand, so occurrences
are dealt out by anchor and only anchors that occur twice go on. Around an anchor the text is cut into
blocks of ``BLOCK`` bytes that are aligned to it. The blocks are the symbols of one sequence for each
task's anchors, whose suffixes are sorted by Lyndon-prefix groups (``suffix_groups``). Neighbours that
share as many blocks as any window holds whole form a class; in a class the windows are compared to
the byte. Contexts that several documents share entirely are sorted once, with their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, small, width
from notelake.llm.suffix_groups import suffix_order
from notelake.llm.textbytes import prefix_sums, span_prints

LENGTH, GRAM, BLOCK = 200, 64, 20
#: Blocks that every window holds whole, wherever it starts.
WHOLE = LENGTH // BLOCK - 1
#: Contexts of an anchor beyond which they are dealt out by their whole blocks as well.
CROWD = 2_000
_LOW = np.uint64((1 << 32) - 1)


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """For each anchor: fingerprint of its run, its place, first window start and end of the last window, fingerprint of that context."""
    codes = np.frombuffer(text, np.uint8)
    sums = prefix_sums(codes)
    at = np.arange(len(codes) - GRAM + 1)
    prints = span_prints(sums, at, at + GRAM)
    least = (prints & ~_LOW) | at.astype(np.uint64)
    size, want = 1, LENGTH - GRAM + 1
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    place = (least & _LOW).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    ends = np.append(starts[1:], len(place)) - 1 + LENGTH
    place = place[starts]
    context = span_prints(sums, starts, ends) ^ ((place - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return prints[place], place, starts, ends, context


def _found(batches):
    for batch in batches:
        rows: list[np.ndarray] = []
        owner = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text is not None and len(text) >= LENGTH:
                made = anchors(text)
                rows.append(np.stack([x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64) for x in made]))
                owner.append(np.full(rows[-1].shape[1], i))
        if rows:
            h, place, start, end, context = np.concatenate(rows, axis=1)
            key = batch.column(0).take(pa.array(np.concatenate(owner)))
            yield pa.RecordBatch.from_arrays([key, pa.array(h), pa.array(context), *[pa.array(x.astype(np.int32)) for x in (place, start, end)]], names=["row", "h", "context", "place", "start", "end"])


def _cut(batches):
    """The contexts asked of each text: whole, or for crowded anchors one piece for each first block."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, asked in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            for a in asked:
                lo, hi = a["start"] - a["place"], a["end"] - a["place"]
                if not a["crowded"]:
                    out.append((a["h"], 0, row, a["place"], lo, a["weight"], text[a["start"] : a["end"]]))
                    continue
                for block in range(-(-lo // BLOCK), -(-(hi - LENGTH) // BLOCK) + 1):
                    first, last = max(lo, BLOCK * (block - 1) + 1), min(hi, BLOCK * block + LENGTH)
                    if last - first >= LENGTH:
                        run = text[a["place"] + BLOCK * block : a["place"] + BLOCK * (block + WHOLE)]
                        sub = int.from_bytes(hashlib.blake2b(run, digest_size=7).digest(), "big") * 64 + (block + 32)
                        out.append((a["h"], sub, row, a["place"], first, a["weight"], text[a["place"] + first : a["place"] + last]))
            if len(out) > 5_000:
                yield _cut_rows(out)
                out = []
        if out:
            yield _cut_rows(out)


def _cut_rows(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "sub", "row", "place", "lo", "weight", "bytes"])


def repeated_windows(keys: np.ndarray, lows: np.ndarray, weights: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """For each context, the window starts (from the anchor) that occur in it and once more.

    ``keys`` number the anchors, ``lows`` are the contexts' first bytes from their anchors.
    """
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    sums = prefix_sums(np.frombuffer(joined, np.uint8))
    first = -(-lows // BLOCK)
    blocks = np.maximum((lows + sizes) // BLOCK - first, 0)
    owner = np.repeat(np.arange(len(texts)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks) + first[owner]
    at = offset[owner] + number * BLOCK - lows[owner]
    mixed = keys[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    symbols = span_prints(sums, at, at + BLOCK) ^ mixed
    order = suffix_order(symbols)
    rest = (np.cumsum(blocks) - 1)[owner] - np.arange(len(owner)) + 1
    order = order[rest[order] >= WHOLE]
    if not len(order):
        return [np.zeros(0, np.int64)] * len(texts)
    same = np.ones(len(order), bool)
    same[0] = False
    for k in range(WHOLE):
        same[1:] &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    classes = np.cumsum(~same) - 1
    held = np.bincount(classes, weights=weights[owner[order]])
    keep = held[classes] > 1
    order, classes = order[keep], classes[keep]
    # Windows whose first whole block is this one: they start up to BLOCK - 1 bytes before it.
    spread = np.arange(-BLOCK + 1, 1)
    start = (number[order] * BLOCK)[:, None] + spread
    context = np.repeat(owner[order][:, None], BLOCK, 1)
    valid = (start >= lows[context]) & (start + LENGTH <= lows[context] + sizes[context])
    start, context, classes = start[valid], context[valid], np.repeat(classes[:, None], BLOCK, 1)[valid]
    begin = offset[context] + start - lows[context]
    name = span_prints(sums, begin, begin + LENGTH) ^ (classes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (start - start.min(initial=0)).astype(np.uint64))
    _, which = np.unique(name, return_inverse=True)
    again = np.bincount(which, weights=weights[context])[which] > 1
    start, context = start[again], context[again]
    by = np.lexsort((start, context))
    return np.split(start[by], np.searchsorted(context[by], np.arange(1, len(texts))))


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows of the length at the sorted starts."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.append(0, gaps)].tolist(), (starts[np.append(gaps - 1, len(starts) - 1)] + length).tolist(), strict=True))


def _sorted_contexts(batches):
    """Spans that repeat, for rows sorted by anchor; whole anchors are taken up to a few MB at a time."""
    held: list[tuple] = []
    size = 0

    def spans(rows):
        ids = {k: i for i, k in enumerate(dict.fromkeys((r[0], r[1]) for r in rows))}
        keys = np.array([ids[r[0], r[1]] for r in rows], np.int64)
        lows, weights = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        out = []
        for r, starts in zip(rows, repeated_windows(keys, lows, weights, [r[6] for r in rows]), strict=True):
            out += [(r[2], r[3] + a, r[3] + b) for a, b in _runs(starts, LENGTH)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row", "start", "end"])

    for batch in batches:
        for r in zip(*(batch.column(n).to_pylist() for n in ("h", "sub", "row", "place", "lo", "weight", "bytes")), strict=True):
            if size > 1 << 20 and held[-1][:2] != r[:2]:
                yield spans(held)
                held, size = [], 0
            held.append(r)
            size += len(r[6])
    if held:
        yield spans(held)


def _removed(batches):
    for batch in batches:
        counts, gone, runs, kept, spans_out = [], [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for m in merged for x in m), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            counts.append(len(text))
            gone.append(len(text) - len(rest))
            runs.append(len(merged))
            kept.append(rest)
            spans_out.append([{"start": a, "end": b} for a, b in merged])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(x, pa.int64()) for x in (counts, gone, runs)], pa.array(spans_out, span), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept``.

    Removed is each byte covered by a ``LENGTH``-byte string that also starts anywhere else in the
    table, the same document included. Strings do not cross documents and are judged on the input.
    ``kept`` is binary: a cut may fall inside a character.

    Null texts count as empty; texts shorter than ``LENGTH`` bytes keep everything. A null id is an id
    like any other. Rows that repeat are documents of their own, so their texts repeat. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    seen = rows.select("row", "text").mapInArrow(_found, "row bigint, h bigint, context bigint, place int, start int, end int")
    parts = width(spark, 2)
    dealt = seen.repartition(parts, "h").withColumn("total", F.count("*").over(Window.partitionBy("h"))).filter("total > 1")
    again = scratch.save(dealt.select("row", "h", "context", "place", "start", "end"))

    contexts = again.repartition(parts, "h").groupBy("h", "context").agg(F.count("*").cast("int").alias("weight"), F.min(F.struct("row", "place", "start", "end")).alias("at"))
    own = Window.partitionBy("h")
    contexts = contexts.withColumns({"kinds": F.count("*").over(own), "lonely": F.min("weight").over(own) == 1})
    contexts = scratch.save(contexts)
    whole = again.join(contexts.filter("weight > 1").select("h", "context"), ["h", "context"], "left_semi").select("row", "start", "end")
    compared = contexts.filter("kinds > 1 and lonely").select("at.row", F.struct("h", "at.place", "at.start", "at.end", "weight", (F.col("kinds") > CROWD).alias("crowded")).alias("a"))
    asked = scratch.save(compared.groupBy("row").agg(F.collect_list("a").alias("asked")))
    texts = rows.select("row", "text").join(small(scratch.save(asked.select("row"))), "row", "left_semi").dropDuplicates(["row"]).join(asked, "row")
    cut = texts.mapInArrow(_cut, "h bigint, sub bigint, row bigint, place int, lo int, weight int, bytes binary")
    cut = cut.repartition(parts, "h", "sub").sortWithinPartitions("h", "sub")
    found = scratch.save(cut.mapInArrow(_sorted_contexts, "row bigint, start int, end int"))
    spans = found.unionByName(whole).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    made = rows.join(spans, "row", "left").select("id", "text", "spans")
    span = "array<struct<start: bigint, end: bigint>>"
    out = made.mapInArrow(_removed, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans {span}, kept binary")
    return out.withColumnRenamed("id", id_col)


def suffix_digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return made.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
