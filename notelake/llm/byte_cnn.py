"""Quality by a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters run over every window of ``WIDTH`` bytes of the whole text.
Overlapping chunks of ``CHUNK`` windows, each beginning in the middle of the one before, are max-pooled per
filter. A text's features are the mean, the largest and the smallest of each filter over its chunks;
they go through one hidden layer into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, small
from notelake.llm.textbytes import small_parts

#: Labelled documents that are learnt from, at most, bytes of each that training sees, and chunks of these a step reads.
FIT_ROWS, FIT_BYTES, FIT_CHUNKS = 6_000, 1 << 14, 8
#: Shape of the network.
VECTOR, WIDTH, FILTERS, HIDDEN, CHUNK = 8, 6, 24, 16, 512
HALF = CHUNK // 2
EPOCHS, BATCH, RATE, DECAY = 8, 32, 4e-3, 1e-4
#: Bytes of text convolved at once, and the byte behind a text's end.
BLOCK, PAD = 1 << 16, 256


class Network:
    """Weights and the passes through them."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "vector": rng.normal(size=(PAD + 1, VECTOR)).astype(np.float32) * np.float32(0.5),
            "filter": scale(WIDTH * VECTOR, FILTERS),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": scale(3 * FILTERS, HIDDEN),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": scale(HIDDEN),
            "out_shift": np.zeros(1, np.float32),
        }
        self.w["vector"][PAD] = 0

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of every window of the byte codes, one row a window."""
        flat = np.ascontiguousarray(self.w["vector"][codes])
        n = len(codes) - WIDTH + 1
        step = flat.strides[0]
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * VECTOR), (step, flat.itemsize), writeable=False)

    def pooled(self, text: bytes) -> np.ndarray:
        """The largest value of each filter in each chunk of the text: at least one chunk, the last may be short."""
        codes = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int16), np.full(WIDTH - 1 + (not text), PAD, np.int16)])
        halves = []
        for a in range(0, len(codes) - WIDTH + 1, BLOCK):
            made = self.windows(codes[a : a + BLOCK + WIDTH - 1]) @ self.w["filter"]
            halves.append(np.maximum.reduceat(made, np.arange(0, len(made), HALF)))
        halves = np.concatenate(halves)
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return np.maximum(chunks + self.w["shift"], 0)

    def features(self, pooled: np.ndarray) -> np.ndarray:
        return np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0)])

    def logits(self, features: np.ndarray) -> np.ndarray:
        return np.tanh(features @ self.w["hidden"] + self.w["hidden_shift"]) @ self.w["out"] + self.w["out_shift"]

    def probability(self, text: bytes) -> float:
        line = float(self.logits(self.features(self.pooled(text))[None])[0])
        return 1 / (1 + np.exp(-np.clip(line, -60, 60)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss over a batch; each text is given as its chunks' byte codes, one row a chunk."""
        w, chunks = self.w, np.concatenate(texts)
        counts = np.array([len(t) for t in texts])
        begins = np.cumsum(counts) - counts
        rows, n = chunks.shape[0], chunks.shape[1] - WIDTH + 1
        flat = np.ascontiguousarray(w["vector"][chunks])
        step = flat.strides
        shown = np.lib.stride_tricks.as_strided(flat, (rows, n, WIDTH * VECTOR), (step[0], step[1], flat.itemsize), writeable=False)
        made = shown.reshape(-1, WIDTH * VECTOR) @ w["filter"]
        made = made.reshape(rows, n, FILTERS)
        behind = chunks[:, :n] == PAD
        behind[:, 0] = False
        made[behind] = -1e9  # windows past the end of a text are none
        at = made.argmax(1)
        best = np.take_along_axis(made, at[:, None], 1)[:, 0] + w["shift"]
        pooled = np.maximum(best, 0)
        top, low = np.maximum.reduceat(pooled, begins), np.minimum.reduceat(pooled, begins)
        features = np.concatenate([np.add.reduceat(pooled, begins) / counts[:, None], top, low], 1)
        inner = np.tanh(features @ w["hidden"] + w["hidden_shift"])
        miss = ((1 / (1 + np.exp(-np.clip(inner @ w["out"] + w["out_shift"], -60, 60))) - labels) / len(labels)).astype(np.float32)
        back = np.outer(miss, w["out"]) * (1 - inner**2)
        to_features = back @ w["hidden"].T
        mean, high, least = np.split(to_features, 3, 1)
        spread = lambda x: np.repeat(x, counts, 0)
        to_pooled = spread(mean / counts[:, None])
        for slope, end in ((high, top), (least, low)):
            level = (pooled == spread(end)).astype(np.float32)  # chunks that are level share the slope
            to_pooled = to_pooled + spread(slope / np.add.reduceat(level, begins)) * level
        to_best = to_pooled * (best > 0)
        # Only the window that won a pool is learnt from: one for each chunk and filter.
        won = shown[np.arange(rows)[:, None], at]
        to_window = to_best[:, :, None] * w["filter"].T[None]
        codes = chunks[np.arange(rows)[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        vector = np.zeros_like(w["vector"])
        np.add.at(vector, codes.ravel(), to_window.reshape(-1, VECTOR))
        vector[PAD] = 0
        return {
            "vector": vector,
            "filter": np.einsum("rfk,rf->kf", won, to_best),
            "shift": to_best.sum(0),
            "hidden": features.T @ back,
            "hidden_shift": back.sum(0),
            "out": inner.T @ miss,
            "out_shift": miss.sum(keepdims=True),
        }


def cut(text: bytes, most: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """A text's chunks as rows of byte codes; ``most`` of them, drawn evenly, if there are more."""
    starts = np.arange(0, max(1, len(text) - HALF), HALF)
    if len(starts) > most:
        starts = np.sort((rng or np.random.default_rng(0)).choice(starts, most, replace=False))
    codes = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int16), np.full(CHUNK + WIDTH, PAD, np.int16)])
    return codes[starts[:, None] + np.arange(CHUNK + WIDTH - 1)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over batches of texts, other chunks of a long text each time; the step falls to nothing."""
    network, rng = Network(seed), np.random.default_rng(seed)
    prior = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    network.w["out_shift"][:] = np.log(prior / (1 - prior))
    first, second = ({k: np.zeros_like(v) for k, v in network.w.items()} for _ in range(2))
    steps = epochs * -(-len(texts) // BATCH)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            slope = network.gradients([cut(texts[j], FIT_CHUNKS, rng) for j in part], labels[part])
            done += 1
            rate = RATE * (1 - (done - 1) / steps)
            for k, g in slope.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                step = first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
                network.w[k] -= (rate * (step + DECAY * network.w[k])).astype(np.float32)
    return network


def excerpt(text: bytes, size: int = FIT_BYTES) -> bytes:
    """For training: a short text whole, of a longer one pieces of a chunk's length at even distances."""
    if len(text) <= size:
        return text
    return b"".join(text[i : i + CHUNK] for i in np.linspace(0, len(text) - CHUNK, size // CHUNK).astype(int))


def _remainder(ids, folds: int):
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds))


def learned(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Network | None:
    """A network for the labels whose crc32(id as text) mod ``folds`` is not ``held_fold``; None without labels."""
    scratch = Scratch(docs.sparkSession, "quality")
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(_remainder(F.col("id"), folds) != held_fold)
    known = taught.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    known = scratch.save(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows))

    def shorten(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([excerpt(t or b"") for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "label", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).join(small(known), "id").select("id", "label", "text")
    # An id that many rows have is bounded like everything else here.
    short = rows.mapInArrow(shorten, f"id {rows.schema['id'].dataType.simpleString()}, label int, text binary")
    made = short.orderBy(F.xxhash64("id"), "id", "text").limit(fit_rows).toArrow()
    return train(made["text"].to_pylist(), made["label"].to_numpy().astype(float)) if made.num_rows else None


def scored(docs: DataFrame, network: Network | None, cut_at: float = 0.3, text_col: str = "text", dropped: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs``, all columns but ``dropped`` kept, with ``score`` and ``predicted``, which replace columns of these names.

    The score depends on the whole text alone; null scores as the empty text. Without a network every score is 0.5.
    """
    spare = [c for c in docs.columns if c not in ("score", "predicted", *dropped)]
    inner = [f"c{i}" for i in range(len(spare))]
    plain = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(spare, inner, strict=True)), F.col(text_col).cast("string").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = sent.value
        for batch in batches:
            for part in small_parts(batch, len(inner), 1 << 20):
                made = [0.5 if net is None else net.probability(t or b"") for t in part.column(len(inner)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, range(len(inner))), pa.array(made, pa.float64())], names=[*inner, "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "text"]
    made = plain.mapInArrow(run, ", ".join([*fields, "score double"]))
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, spare, strict=True)), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, cut_at: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` in 0 to 1 and ``predicted``.

    Labels teach only where crc32(id as text) mod ``folds`` is not ``held_fold``; an id labelled more than
    once counts as good if any row says so, null labels and ids teach nothing. Beyond ``fit_rows`` labelled
    ids those first by a hash teach, each with ``FIT_BYTES`` bytes at most; scoring reads every byte. A null
    id is not held out. Rows that repeat are rows of their own; other columns are ignored; an empty table
    gives an empty result.
    """
    network = learned(docs, labels, folds, held_fold, id_col, text_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = scored(rows, network, cut_at, dropped=("text",))
    held = F.coalesce(_remainder(F.col("id"), folds) == held_fold, F.lit(False))
    return made.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted")
