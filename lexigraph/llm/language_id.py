"""Language identification by sparse multinomial logistic regression.

Features: character 1- to 3-grams of the lower-cased letters (anything else
is a blank), hashed to ``2**bits`` buckets, weighted by (1 + ln count) times
inverse document frequency, scaled to length one.  Training: follow the
regularised leader (per coordinate step sizes, L1 and L2 penalties), run on
several shards of the training sample at once, the shards' states averaged
after each pass.  A temperature then fits the probabilities to a part of
the sample that was not trained on.

Document frequencies cover all training documents.  Only the fit itself
reads a sample, of about ``per_language`` documents of each language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import map_arrow, row_function, values
from .words import mix64

_MULT = mix64(np.arange(1, 7, dtype=np.uint64))
_BLANK = 32
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point to itself if a letter, else to a blank; and a 64-bit mark of
    each code point below 2**16 (others share them, by their low bits)."""
    if not _TABLES:
        letter = np.fromiter((i if chr(i).isalpha() else _BLANK for i in range(0x110000)), dtype=np.uint32, count=0x110000)
        _TABLES["t"] = letter, mix64(np.arange(1, 65537, dtype=np.uint64))
    return _TABLES["t"]


def gram_buckets(text: str, bits: int) -> np.ndarray:
    """Buckets of all 1- to 3-grams of a text; empty if it has no letter."""
    letter, mark = _tables()
    points = letter[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    blank = points == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after a word
    points = points[keep]
    if not len(points) or (len(points) == 1 and points[0] == _BLANK):
        return np.zeros(0, dtype=np.int64)
    m = mark[np.concatenate([[_BLANK], points, [_BLANK]]) & np.uint32(0xFFFF)]
    shift = np.uint64(64 - bits)
    one = (m[1:-1] * _MULT[0]) >> shift
    two = (m[:-1] * _MULT[1] + m[1:] * _MULT[2]) >> shift
    three = (m[:-2] * _MULT[3] + m[1:-1] * _MULT[4] + m[2:] * _MULT[5]) >> shift
    return np.concatenate([one, two, three]).astype(np.int64)


@dataclass
class LanguageModel:
    """labels, weights (buckets + bias, labels), idf and temperature."""

    bits: int
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        grams = gram_buckets(text, self.bits)
        if not len(grams):
            return None
        count = np.bincount(grams, minlength=1 << self.bits)
        at = np.flatnonzero(count)
        x = (1.0 + np.log(count[at])) * self.idf[at]
        length = np.sqrt((x * x).sum())
        x = x / length if length > 0 else x
        return np.append(at, 1 << self.bits), np.append(x, 1.0)

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weights[at] / self.temperature)

    def predict(self, text: str) -> tuple[str, float]:
        v = self.vector(text)
        if v is None or not self.labels:
            return "und", 0.0
        p = self.probabilities(*v)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Ftrl:
    """State of the leader: z and n, (features, labels)."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _document_frequency(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Documents per bucket, and documents with a letter: sums over tasks."""
    def run(batches):
        df, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                grams = gram_buckets(t, bits)
                if len(grams):
                    df += np.bincount(grams, minlength=1 << bits) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1)), "df": pa.array(np.append(df[at], n))})

    got = map_arrow(docs.select("text"), run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = got["bucket"].to_numpy(), got["df"].to_numpy()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[bucket[bucket >= 0]] = df[bucket >= 0]
    return out, int(df[bucket < 0].sum())


def train(docs: DataFrame, bits: int = 15, per_language: int = 1_000, shards: int = 4, passes: int = 3, seed: int = 7) -> LanguageModel:
    """Fits a model to ``docs`` (doc_id, text, lang); rows without text or
    lang are left out.  The sample holds about ``per_language`` rows of each
    lang, picked by hash; a fifth of it calibrates."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    labels = sorted(counts)
    df, n = _document_frequency(rows, bits)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    model = LanguageModel(bits, labels, idf, np.zeros(((1 << bits) + 1, len(labels))))
    if not labels or not n:
        return model
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    index = {k: i for i, k in enumerate(labels)}

    def vectors(batches):
        for batch in batches:
            for i, lang in zip(range(batch.num_rows), batch.column("lang").to_pylist()):
                v = model.vector(batch.column("text")[i].as_py())
                if v is not None:
                    yield pa.RecordBatch.from_pydict({"label": pa.array([index[lang]], pa.int32()), "deal": batch.column("deal").slice(i, 1),
                                                      "at": pa.array([v[0].astype(np.int32)], pa.list_(pa.int32())), "x": pa.array([v[1].astype(np.float32)], pa.list_(pa.float32()))})

    sample = rows.withColumn("deal", F.xxhash64("doc_id", "text", F.lit(seed + 1))).where(draw < F.element_at(share, F.col("lang")))
    sample = cut_lineage(map_arrow(sample, vectors, "label int, deal long, at array<int>, x array<float>"))
    fit = sample.where(F.pmod("deal", F.lit(5)) > 0).withColumn("shard", F.pmod(F.shiftright("deal", 8), F.lit(shards)))
    state = Ftrl(np.zeros_like(model.weights), np.zeros_like(model.weights))
    for _ in range(passes):
        state = _pass(fit, state, shards)
    model.weights = state.weights()
    model.temperature = _temperature(sample.where(F.pmod("deal", F.lit(5)) == 0), model)
    return model


def _pass(fit: DataFrame, state: Ftrl, shards: int) -> Ftrl:
    """One pass of every shard from the common state; the mean of theirs."""
    def learn(table: pa.Table) -> pa.Table:
        own = Ftrl(state.z.copy(), state.n.copy(), state.alpha, state.beta, state.l1, state.l2)
        table = table.sort_by("deal")
        for label, at, x in zip(table["label"].to_pylist(), table["at"], table["x"]):
            own.learn(at.values.to_numpy(), x.values.to_numpy().astype(np.float64), label)
        f, c = np.nonzero(own.n)
        return pa.table({"f": pa.array(f), "c": pa.array(c), "z": own.z[f, c], "n": own.n[f, c]})

    got = fit.groupBy("shard").applyInArrow(learn, "f long, c long, z double, n double")
    # at most buckets * labels rows reach the driver
    mean = got.groupBy("f", "c").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toArrow()
    out = Ftrl(np.zeros_like(state.z), np.zeros_like(state.n), state.alpha, state.beta, state.l1, state.l2)
    f, c = mean["f"].to_numpy(), mean["c"].to_numpy()
    out.z[f, c], out.n[f, c] = mean["z"].to_numpy(), mean["n"].to_numpy()
    return out


def _temperature(sample: DataFrame, model: LanguageModel) -> float:
    """Of a grid, the temperature of least log loss on the sample."""
    grid = np.geomspace(0.02, 20.0, 121)

    def losses(batches):
        total = np.zeros(len(grid))
        for batch in batches:
            for label, at, x in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("x")):
                logits = x.values.to_numpy() @ model.weights[at.values.to_numpy()]
                scaled = logits[None, :] / grid[:, None]
                scaled -= scaled.max(axis=1, keepdims=True)
                total += np.log(np.exp(scaled).sum(axis=1)) - scaled[:, label]
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(grid))), "loss": pa.array(total)})

    got = map_arrow(sample, losses, "i long, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("loss", F.abs(F.col("i") - len(grid) // 2)).first()
    return float(grid[got["i"]]) if got and got["loss"] else 1.0


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1).  ``und`` and 0 where the
    text is null or has no letter, or no language was learned."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # buckets * labels numbers

    def compute(texts):
        got = [spread.value.predict(t) for t in texts]
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = docs.select(*keep, F.col("text").alias("_text"))
    return map_arrow(text, row_function(compute, "_text", keep, empty=""), schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Learns from the rows with a lang whose doc_id isn't held out (CRC-32 of
    its text, modulo 5, is 0); lang, source and doc_id are no inputs of a
    prediction.  Null or letterless text: und, 0.  Null doc_id: held out.
    Repeated rows: predicted alike.  No row to learn from: und everywhere.
    An empty table gives no row.  Very long texts are read whole, one after
    another.  Equal probabilities: the first of the model's languages.
    Further columns, whatever their names, aren't looked at.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
