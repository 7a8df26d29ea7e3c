"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters at every other position; a document
is covered whole by overlapping chunks of 64 positions, each 32 on from the last. A
chunk's mean and maximum of every filter go through a layer of hidden units, whose largest
values over all chunks are combined into one probability.

Training is on the driver, on a bounded sample of labelled rows (``SAMPLE`` of each label, by the
smallest hashes of doc_id; of a text of over ``SAMPLE_BYTES`` a stretch of so many bytes from a
seeded place on), with gradients written out by hand. Scoring runs where the texts are: the filters become tables over
pairs of bytes, so a position costs a few table rows, and memory is bounded by a slice of
a text and 48 numbers for every 64 bytes.

Defined results: a null or empty text is one chunk of zero bytes and gets a score like
any other. A doc_id with several labels counts with the smallest, and one with several texts with
the one of the smallest hash, so reruns learn the same network; labels or documents of a null doc_id
aren't learned from. Without labelled rows of both kinds every score is the share of label 1, or 0.5.
Equal texts have equal scores. Other columns are kept, and new columns replace ones of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED, WIDTH, FILTERS, HIDDEN = 8, 6, 24, 24
#: Positions (two bytes each) of half a chunk.
HALF = 32
SAMPLE, SAMPLE_BYTES = 900, 20_000
EPOCHS, BATCH, RATE = 12, 24, 4e-3
THRESHOLD = 0.3


def _padded(data: np.ndarray) -> np.ndarray:
    """The bytes with zeros after them to whole halves, two at least, and what the last filter reaches over."""
    positions = max(2 * HALF, -(-max(1, (len(data) + 1) // 2) // HALF) * HALF)
    out = np.zeros(2 * positions + WIDTH, np.uint8)
    out[: len(data)] = data
    return out


class Network:
    """Parameters, and the forward and backward passes over one document."""

    NAMES = ("embed", "conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 3) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = r.normal(0, (WIDTH * EMBED) ** -0.5 * 1.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.conv_bias = np.zeros(FILTERS, np.float32)
        self.hidden = r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.shift = 0.0

    def _windows(self, data: np.ndarray) -> np.ndarray:
        """Embedded bytes under the filters at each position."""
        at = np.arange((len(data) - WIDTH) // 2)[:, None] * 2 + np.arange(WIDTH)
        return data[at]

    def gradients(self, data: np.ndarray, label: float, weight: float) -> tuple[float, dict[str, np.ndarray]]:
        codes = self._windows(_padded(data))
        x = self.embed[codes].reshape(len(codes), -1)
        a = x @ self.conv + self.conv_bias
        z = np.maximum(a, 0)
        halves = z.reshape(-1, HALF, FILTERS)
        sums, top = halves.sum(1), halves.argmax(1)
        high = np.take_along_axis(halves, top[:, None], 1)[:, 0]
        right = high[1:] > high[:-1]
        pooled = np.concatenate([(sums[:-1] + sums[1:]) / (2 * HALF), np.maximum(high[:-1], high[1:])], 1)
        h = np.tanh(pooled @ self.hidden + self.hidden_bias)
        best = h.argmax(0)
        units = h[best, np.arange(HIDDEN)]
        p = 1 / (1 + np.exp(-(units @ self.out + self.out_bias[0])))
        loss = -weight * (label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9))
        d = weight * (p - label)
        g = {"out": d * units, "out_bias": np.array([d], np.float32)}
        du = d * self.out * (1 - units**2)
        g["hidden_bias"] = du
        g["hidden"] = pooled[best].T * du
        dpool = np.zeros_like(pooled)
        np.add.at(dpool, best, (self.hidden * du).T)
        dz = np.zeros_like(halves)
        mean = dpool[:, :FILTERS] / (2 * HALF)
        dz[:-1] += mean[:, None]
        dz[1:] += mean[:, None]
        dmax = dpool[:, FILTERS:]
        k = np.arange(len(halves))[:, None], top, np.arange(FILTERS)[None]
        per = np.zeros_like(high)
        per[:-1] += np.where(right, 0, dmax)
        per[1:] += np.where(right, dmax, 0)
        dz[k] += per
        da = dz.reshape(-1, FILTERS) * (a > 0)
        used = np.flatnonzero(da.any(1))
        da, x, codes = da[used], x[used], codes[used]
        g["conv"], g["conv_bias"] = x.T @ da, da.sum(0)
        dx = (da @ self.conv.T).reshape(-1, EMBED)
        flat = codes.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, dx[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
        return float(loss), g

    def tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring bytes adds to the filters at each pair of places."""
        out = []
        for k in range(0, WIDTH, 2):
            one = self.embed @ self.conv[k * EMBED : (k + 1) * EMBED]
            two = self.embed @ self.conv[(k + 1) * EMBED : (k + 2) * EMBED]
            out.append((one[None] + two[:, None]).reshape(65536, FILTERS).astype(np.float32))  # low byte first
        out[0] += self.conv_bias
        return out

    def score(self, data: np.ndarray, tables: list[np.ndarray], piece: int = 4096) -> float:
        data = _padded(data)
        pairs = data[: len(data) // 2 * 2].view("<u2")
        n = (len(data) - WIDTH) // 2
        sums, high = np.empty((n // HALF, FILTERS), np.float32), np.empty((n // HALF, FILTERS), np.float32)
        for a in range(0, n, piece):
            b = min(n, a + piece)
            z = tables[0].take(pairs[a:b], 0)
            for k in range(1, WIDTH // 2):
                z += tables[k].take(pairs[a + k : b + k], 0)
            z = np.maximum(z, 0, out=z).reshape(-1, HALF, FILTERS)
            sums[a // HALF : b // HALF] = z.sum(1)
            high[a // HALF : b // HALF] = z.max(1)
        units = np.full(HIDDEN, -2, np.float32)
        for a in range(0, len(sums) - 1, 1 << 16):
            s, h = sums[a : a + (1 << 16) + 1], high[a : a + (1 << 16) + 1]
            pooled = np.concatenate([(s[:-1] + s[1:]) / (2 * HALF), np.maximum(h[:-1], h[1:])], 1)
            units = np.maximum(units, np.tanh(pooled @ self.hidden + self.hidden_bias).max(0))
        return float(1 / (1 + np.exp(-(float(units @ self.out) + float(self.out_bias[0]) + self.shift))))


def train(rows: list[tuple[bytes, int]], share: float, *, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """A network fitted to (text, label); share: of label 1 among all labelled rows, to which scores are shifted."""
    net = Network(seed)
    r = np.random.Generator(np.random.PCG64(seed + 1))
    data = [(np.frombuffer(t, np.uint8), float(y)) for t, y in rows]
    ones = sum(y for _, y in data)
    weight = {1.0: len(data) / 2 / max(ones, 1), 0.0: len(data) / 2 / max(len(data) - ones, 1)}
    first = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    second = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for start in range(0, len(data), BATCH):
            batch = order[start : start + BATCH]
            total: dict[str, np.ndarray] = {}
            for i in batch:
                _, g = net.gradients(data[i][0], data[i][1], weight[data[i][1]])
                for n, x in g.items():
                    total[n] = total[n] + x if n in total else x
            step += 1
            rate = RATE * min(1.0, step / 30) * (1 - 0.95 * step / steps)
            for n, x in total.items():
                x = x / len(batch)
                first[n] = 0.9 * first[n] + 0.1 * x
                second[n] = 0.98 * second[n] + 0.02 * x * x
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.98**step)) + 1e-7)
                setattr(net, n, (getattr(net, n) - rate * move - rate * 1e-3 * getattr(net, n)).astype(np.float32))
    net.shift = float(np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network | float:
    """Learns from labelled documents whose doc_id isn't held out; a number if there is just one label or none."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and crc32(cast(cast(id as string) as binary)) % 5 != 0").groupBy("id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    # ids first, of those that there are texts of: texts are read once, and only the chosen rows' leave their place
    there = known.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    chosen = [there.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample) for y in (0, 1)]
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    spare = F.greatest(F.octet_length(data) - SAMPLE_BYTES, F.lit(0))
    piece = F.substring(data, (F.pmod(F.xxhash64(F.lit(13), doc_id), spare + 1) + 1).cast("int"), F.lit(SAMPLE_BYTES))
    texts = docs.select(F.col(doc_id).alias("id"), piece.alias("piece"), F.xxhash64(data).alias("h")).join(F.broadcast(chosen[0].union(chosen[1])), "id")  # 2 x SAMPLE rows at most
    got = texts.groupBy("id", "y").agg(F.min_by("piece", "h").alias("piece")).collect()
    if len({r["y"] for r in got}) < 2:
        return counts[1] / (counts[0] + counts[1])
    got.sort(key=lambda r: r["id"])
    return train([(bytes(r["piece"]), r["y"]) for r in got], counts[1] / (counts[0] + counts[1]))


def score(df: DataFrame, model: Network | float, *, text: str = "text", column: str = "score") -> DataFrame:
    """df with the probability of label 1 of every whole text."""
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(column, T.DoubleType(), False)])
    if isinstance(model, float):
        return df.select(*kept, F.lit(model).alias(column))
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 10 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [net.score(np.frombuffer((x.as_py() or "").encode(), np.uint8), tables) for x in batch.column(at)]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.float64())], names=[*kept, column])

    return df.select(*kept).mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """df with held_out, score and predicted."""
    model = fit(df, labels, doc_id=doc_id, text=text, label=label)
    scored = score(df.drop("held_out", "predicted"), model, text=text)
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
