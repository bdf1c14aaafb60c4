"""Counts of stems beside their chunk, and BM25 of many queries in the task that holds the chunks.

A chunk's counts stay one row, so neither its words nor its scores are shuffled: a task adds up the
scores of a block of chunks for all queries and passes on only what a query's limit can still reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.words import stem_dictionary, words

#: BM25 constants and field weights.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 5.0, "heading": 2.0, "text": 1.0, "keywords": 3.0}
#: Words counted, cells of chunks times queries and parts of scores added up at a time, about.
WORDS, CELLS, PARTS = 1 << 17, 1 << 20, 1 << 20


def weighted_words(fields: dict[str, str]) -> Column:
    """``array<struct<weight, words>>``: the words of each field of a chunk."""
    return F.array(*[F.struct(F.lit(FIELD_WEIGHTS.get(field, 1.0)).alias("weight"), words(F.col(column)).alias("words")) for field, column in fields.items()])


def _slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows whose sizes add up to about ``most``; a larger row is alone or first."""
    at = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _held(fields: pa.Array, wanted: frozenset[str] | None, stemmed: bool) -> pa.StructArray:
    """Number of words, and each stem (or word) with its weighted count, of some chunks."""
    n, each = len(fields), fields.flatten()
    per_field = np.repeat(np.arange(n), _sizes(fields))
    lists, weight = pc.struct_field(each, "words"), pc.struct_field(each, "weight").to_numpy(zero_copy_only=False)
    sizes = _sizes(lists)
    total = np.bincount(per_field, sizes, n).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    numbers: dict[str, int] = {}
    stems = stem_dictionary(coded.dictionary) if stemmed else coded.dictionary.to_pylist()
    number = np.array([numbers.setdefault(s, len(numbers)) if wanted is None or s in wanted else -1 for s in stems], np.int64)
    code = number[coded.indices.to_numpy(zero_copy_only=False)] if len(stems) else np.zeros(0, np.int64)
    row, share = np.repeat(per_field, sizes), np.repeat(weight, sizes)
    some = code >= 0
    kinds = max(1, len(numbers))
    found, place = np.unique(row[some] * kinds + code[some], return_inverse=True)
    offsets = pa.array(np.searchsorted(found, np.arange(n + 1) * kinds).astype(np.int32))
    tokens = pa.array(list(numbers), pa.string()).take(pa.array(found % kinds))
    counts = pa.array(np.bincount(place, share[some], len(found)).astype(np.float64))
    return pa.StructArray.from_arrays([pa.array(total), pa.ListArray.from_arrays(offsets, tokens), pa.ListArray.from_arrays(offsets, counts)], names=["len", "tokens", "f"])


def counted(weighted: Column, wanted: list[str] | None = None, stemmed: bool = True) -> Column:
    """``struct<len, tokens, f>`` of ``weighted_words``: number of words, and the distinct stems (those ``wanted``) with their weighted counts.

    Not ``stemmed``, words are counted as they are.
    """
    only = None if wanted is None else frozenset(wanted)

    def run(fields: pa.Array) -> pa.Array:
        words_in = pc.struct_field(fields.flatten(), "words")
        row = np.repeat(np.arange(len(fields)), _sizes(fields))
        made = [_held(fields.slice(a, b - a), only, stemmed) for a, b in _slices(np.bincount(row, _sizes(words_in), len(fields)).astype(np.int64), WORDS)]
        whole = pa.concat_arrays(made) if made else _held(fields, only, stemmed)
        del made
        pa.default_memory_pool().release_unused()  # what a batch of long texts took is not kept by each worker
        return whole

    return F.arrow_udf(run, "struct<len:bigint,tokens:array<string>,f:array<double>>")(weighted)


class Asked(NamedTuple):
    """Queries by number, and of each asked stem its weight and the queries from ``starts`` to ``ends`` in ``by``.

    Without an average length counts are added up as they are.
    """

    queries: list
    numbers: dict[str, int]
    weight: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    by: np.ndarray
    average: float | None


def asked_of(rows: list, chunks: int | None = None, total_words: int = 0) -> Asked:
    """Of collected rows ``(query_id, token, df)``; a pair occurs once. Without a number of chunks counts are not weighted."""
    queries = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in rows))}
    ordered = sorted(rows, key=lambda r: r["token"])
    numbers: dict[str, int] = {}
    token = np.array([numbers.setdefault(r["token"], len(numbers)) for r in ordered], np.int64)
    size = np.bincount(token, minlength=len(numbers))
    by = np.array([queries[r["query_id"]] for r in ordered], np.int64)
    starts, ends = np.cumsum(size) - size, np.cumsum(size)
    if chunks is None:
        return Asked(list(queries), numbers, np.ones(len(numbers)), starts, ends, by, None)
    df = np.zeros(len(numbers))
    df[token] = [r["df"] for r in ordered]
    value = np.log((chunks - df + 0.5) / (df + 0.5))
    return Asked(list(queries), numbers, np.where(value > 0, value, 1e-6), starts, ends, by, total_words / chunks if chunks else 0.0)


def _scores(asked: Asked, length: np.ndarray, held: pa.StructArray) -> np.ndarray:
    """Scores of chunks times queries, rounded; -1 where a chunk holds no stem of the query."""
    n, nq = len(length), len(asked.queries)
    tokens, f = pc.struct_field(held, "tokens"), pc.struct_field(held, "f")
    coded = tokens.flatten().dictionary_encode()
    number = np.array([asked.numbers.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    token = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
    row, f = np.repeat(np.arange(n), _sizes(tokens)), f.flatten().to_numpy(zero_copy_only=False)
    some = token >= 0
    row, f, token = row[some], f[some], token[some]
    part = f
    if asked.average is not None and len(token):
        part = asked.weight[token] * (f * (K1 + 1) / (f + K1 * (1 - B + B * length[row] / asked.average)))
    size = (asked.ends - asked.starts)[token]
    made = np.zeros(n * nq)
    for a, b in _slices(size, PARTS):
        many = size[a:b]
        at = np.arange(many.sum()) + np.repeat(asked.starts[token[a:b]] - (np.cumsum(many) - many), many)
        made += np.bincount(np.repeat(row[a:b] * nq, many) + asked.by[at], np.repeat(part[a:b], many), n * nq)
    return np.where(made > 0, np.floor(made * 1e9 + 0.5) / 1e9, -1.0).reshape(n, nq)


def _first(table: pa.Table, key: str, group: str, limit: int) -> pa.Table:
    """Of each query the best row of each group, and of these the first ``limit``."""
    table = table.take(pc.sort_indices(table, sort_keys=[("query", "ascending"), ("score", "descending"), (key, "ascending")], null_placement="at_start"))
    if group != key:
        named = table.column(group).combine_chunks().dictionary_encode(null_encoding="encode")
        code = table.column("query").to_numpy() * len(named.dictionary) + named.indices.to_numpy(zero_copy_only=False)
        table = table.take(np.sort(np.unique(code, return_index=True)[1]))
    query = table.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return table.filter(pa.array(place < limit))


def _blocks(batches: Iterator[pa.RecordBatch], nq: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, nq))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _searched(asked: Callable[[], Asked], key: str, group: str, limit: int | None, least: bool, query_type: pa.DataType, keys: list[str]):
    """Rows ``(query_id, keys..., score)``: all that hold a stem, those that reach ``least``, or the first ``limit`` of each task."""

    def run(batches):
        ask, floor = asked()
        nq = len(ask.queries)
        names = pa.array(ask.queries, query_type)
        place = {q: i for i, q in enumerate(ask.queries)}
        best, reach = None, np.full(nq, -1.0)
        for block in _blocks(batches, nq):
            made = _scores(ask, block.column("len").to_numpy(), block.column("held"))
            if "admitted" in block.schema.names:
                lists = block.column("admitted")
                row = np.repeat(np.arange(block.num_rows), _sizes(lists))
                query = np.array([place.get(q, -1) for q in lists.flatten().to_pylist()], np.int64)
                open_ = np.zeros(made.shape, bool)
                open_[row[query >= 0], query[query >= 0]] = True
                made = np.where(open_, made, -1.0)
            wanted = made >= 0
            if least:
                wanted &= made >= floor
            if limit is not None:
                tops = made
                if group != key:
                    owner = block.column(group).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(owner, kind="stable")
                    tops = np.maximum.reduceat(made[order], np.flatnonzero(np.diff(owner[order], prepend=-1)), axis=0)
                if len(tops) > limit:
                    wanted &= made >= np.partition(tops, len(tops) - limit, axis=0)[len(tops) - limit]
                wanted &= made >= reach
            row, query = np.nonzero(wanted)
            out = pa.table({"query": query, **{k: block.column(k).take(pa.array(row)) for k in keys}, "score": made[row, query]})
            if limit is None:
                yield from _named(out, names)
            elif len(row):
                best = _first(out if best is None else pa.concat_tables([best, out]), key, group, limit)
                held = best.column("query").to_numpy()
                last = np.flatnonzero(np.diff(held, append=-1))
                full = np.bincount(held, minlength=nq)[held[last]] >= limit
                reach[held[last[full]]] = best.column("score").to_numpy()[last[full]]
        if best is not None:
            yield from _named(best, names)

    def _named(table: pa.Table, names: pa.Array):
        queries = names.take(table.column("query").combine_chunks())
        yield from pa.table({"query_id": queries, **{k: table.column(k) for k in keys}, "score": table.column("score")}).to_batches(max_chunksize=1 << 16)

    return run


def scored(held: DataFrame, asked: Asked, query_type, keys: list[str], key: str, limit: int | None = None, group: str | None = None, least: dict | None = None) -> DataFrame:
    """``(query_id, keys..., score)`` of ``held(keys..., len, held)`` by the task that reads it.

    With ``limit`` each task passes on, of each query, the rows of its first ``limit`` groups (by score,
    ties by ``key``), each with its best row; the first ones of all tasks are among them. ``least`` gives
    the score that rows of a query have to reach; queries without one have no rows. A column ``admitted``
    holds the queries that a chunk is open to.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    floor = np.array([least.get(q, np.inf) for q in asked.queries]) if least is not None else np.zeros(0)
    sent = held.sparkSession.sparkContext.broadcast((asked, floor))
    columns = [*dict.fromkeys(keys), "len", "held", *(["admitted"] if "admitted" in held.columns else [])]
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join([f"query_id {query_type.simpleString()}", *(f"`{k}` {types[k]}" for k in keys), "score double"])
    return held.select(*columns).mapInArrow(_searched(lambda: sent.value, key, group or key, limit, least is not None, to_arrow_type(query_type), keys), schema)
