"""A convolutional text classifier for toxicity, trained in numpy on a bounded sample of labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.llm.common import in_small_batches, table

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 12, (1, 2, 3)
#: Labelled rows of either class that the classifier is fitted on, at most; chosen by a seeded hash of the id.
SAMPLE_A_CLASS = 2000
#: Share of the sample that only calibrates thresholds; positives a language needs for one of its own.
CALIBRATION, LEAST_POSITIVES = 0.3, 15
EPOCHS, BATCH, RATE = 14, 32, 0.08
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = 1 + len(PREFIXES)
#: Words a worker remembers the projections of; long texts are read in steps of so many words.
REMEMBERED, STEP = 100_000, 16_384
#: Function words by language, for telling the language of a text from the text alone.  Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this by from or at",
    "fr": "de le la et les des en un une que est pour qui dans du par au sur pas avec",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein als auch eine",
    "es": "de la que el en y los del se las por un para con no una su al lo es",
}
_tokens = re.compile(r"\w+").findall


def features(word: str) -> list[int]:
    """Buckets of a word and of its prefixes in bytes, so that inflected forms share what they begin with."""
    raw = word.encode("utf-8", "surrogatepass")
    return [crc32(raw, 77) % BUCKETS, *[crc32(raw[:n], n) % BUCKETS for n in PREFIXES]]


_LANGUAGES = sorted(FUNCTION_WORDS)
_NONE = [0] * len(_LANGUAGES)
_SPOKEN: dict[str, list[int]] = {}
for _i, _name in enumerate(_LANGUAGES):
    for _w in FUNCTION_WORDS[_name].split():
        _SPOKEN.setdefault(_w, [0] * len(_LANGUAGES))[_i] = 1


def votes(words: list[str]) -> np.ndarray:
    """How many of the words are function words of each language."""
    return np.array([_SPOKEN.get(w, _NONE) for w in words], np.float32).reshape(-1, len(_LANGUAGES))


def language(votes: np.ndarray, words: int) -> str:
    """The language most of whose function words a text uses, or ``other`` where fewer than one word in fifty is one."""
    best = int(votes.argmax())
    return _LANGUAGES[best] if votes[best] > 0 and votes[best] * 50 >= words else "other"


@dataclass
class Model:
    """Weights and thresholds; a few MB whatever the corpus."""

    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def projection(self) -> np.ndarray:
        """Every kernel row side by side: one product gives a word's part in each filter and offset."""
        return np.concatenate([k[j] for k in self.kernels for j in range(len(k))], axis=1)

    def pooled(self, parts: np.ndarray, first: bool = True, last: bool = True) -> np.ndarray:
        """Largest response of each filter over a text given by its words' projections.

        The ends of the text are padded by zeros; a step that is not first or last has no windows beyond that end.
        """
        n, at, best = len(parts), 0, []
        for k in self.kernels:
            w = len(k)
            h = np.zeros((n + w - 1, FILTERS), np.float32)
            for j in range(w):
                h[w - 1 - j : w - 1 - j + n] += parts[:, at : at + FILTERS]
                at += FILTERS
            h = h[0 if first else w - 1 : len(h) if last else n]
            best.append(h.max(axis=0) if len(h) else np.full(FILTERS, -np.inf if n else 0, np.float32))
        return np.concatenate(best)

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.out + self.shift)

    def score(self, logit: float, spoken: str) -> float:
        """Calibrated: the language's threshold lies at 0.5."""
        return float(1 / (1 + np.exp(-np.clip(logit - self.thresholds.get(spoken, self.thresholds[""]), -30, 30))))


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: list[str], seed: int = 3) -> Model:
    """Train on hashed texts (each ``words x FEATURES``), then set a threshold for each language.

    Only the word windows that win the pooling get a gradient, so a step touches few table rows; rates
    are adapted by row.  Without both classes the model scores every text by the prior alone, and by less than 0.5
    unless there are toxic rows: without labels nothing is called toxic.
    """
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32) / FEATURES**0.5,
        [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(f, np.float32), rng.normal(0, 0.2, f).astype(np.float32), 0.0,
    )
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.out[:] = 0
        model.thresholds = {"": float(np.log((len(y) - y.sum() + 1) / (y.sum() + 0.5)))}
        return model
    held = rng.random(len(y)) < CALIBRATION
    own = np.flatnonzero(~held)
    if len(set(y[own])) < 2 or len(set(y[held])) < 2:
        own, held = np.arange(len(y)), np.ones(len(y), bool)
    share = y[own].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    sums = {"table": np.full(BUCKETS, 1e-4, np.float32), "kernels": [np.full_like(k, 1e-4) for k in model.kernels], "bias": np.full(f, 1e-4), "out": np.full(f, 1e-4), "shift": 1e-4}

    def padded(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(texts[i]) for i in batch])
        starts = np.cumsum(lengths + 2 * (max(WIDTHS) - 1)) - lengths - (max(WIDTHS) - 1)
        x = np.zeros((int((lengths + 2 * (max(WIDTHS) - 1)).sum()), DIM), np.float32)
        for i, s in zip(batch, starts, strict=True):
            x[s : s + len(texts[i])] = model.table[texts[i]].sum(axis=1)
        return x, starts, lengths

    def forward(batch: np.ndarray):
        x, starts, lengths = padded(batch)
        best, where = np.zeros((len(batch), f), np.float32), np.zeros((len(batch), f), np.int64)
        for b, k in enumerate(model.kernels):
            w = len(k)
            h = sum(x[j : len(x) - w + 1 + j] @ k[j] for j in range(w))
            for d, (s, n) in enumerate(zip(starts, lengths, strict=True)):
                if n:
                    part = h[s - w + 1 : s + n]
                    at = part.argmax(axis=0)
                    where[d, b * FILTERS : (b + 1) * FILTERS] = at + s - w + 1
                    best[d, b * FILTERS : (b + 1) * FILTERS] = part[at, np.arange(FILTERS)]
        return x, starts, lengths, best, where

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.01
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            x, starts, lengths, best, where = forward(batch)
            z = np.maximum(best + model.bias, 0)
            g = (1 / (1 + np.exp(-np.clip(z @ model.out + model.shift, -30, 30))) - y[batch]) * weight[batch] / len(batch)
            gz = g[:, None] * model.out * (z > 0)
            grads = {"out": z.T @ g + 1e-4 * model.out, "bias": gz.sum(axis=0)}
            rows, deltas = [], []
            for b, k in enumerate(model.kernels):
                side = slice(b * FILTERS, (b + 1) * FILTERS)
                gk = np.zeros_like(k)
                for j in range(len(k)):
                    word = where[:, side] + j
                    gk[j] = np.einsum("dfe,df->ef", x[word], gz[:, side])
                    inside = (word >= starts[:, None]) & (word < (starts + lengths)[:, None]) & (gz[:, side] != 0)
                    d, c = np.nonzero(inside)
                    delta = gz[:, side][d, c][:, None] * k[j].T[c]
                    for i in np.unique(d):
                        mine = d == i
                        rows.append(texts[batch[i]][word[i, c[mine]] - starts[i]].ravel())
                        deltas.append(np.repeat(delta[mine], FEATURES, axis=0))
                sums["kernels"][b] += gk**2
                k -= (rate * gk / np.sqrt(sums["kernels"][b])).astype(np.float32) * 0.3
            for name in ("out", "bias"):
                sums[name] += grads[name] ** 2
                value = getattr(model, name)
                value -= (rate * grads[name] / np.sqrt(sums[name])).astype(np.float32)
            sums["shift"] += float(g.sum()) ** 2
            model.shift -= rate * float(g.sum()) / sums["shift"] ** 0.5
            if rows:
                ids, back = np.unique(np.concatenate(rows), return_inverse=True)
                step = np.zeros((len(ids), DIM), np.float32)
                np.add.at(step, back, np.concatenate(deltas))
                sums["table"][ids] += (step**2).mean(axis=1)
                model.table[ids] -= rate * step / np.sqrt(sums["table"][ids])[:, None]

    checked = np.flatnonzero(held)
    logits = np.concatenate([(np.maximum(forward(checked[i : i + BATCH])[3] + model.bias, 0) @ model.out + model.shift) for i in range(0, len(checked), BATCH)])
    model.thresholds[""] = threshold(logits, y[checked])
    spoken = np.array([languages[i] for i in checked])
    for name in map(str, sorted(set(spoken))):
        mine = spoken == name
        if min(y[checked][mine].sum(), (1 - y[checked][mine]).sum()) >= LEAST_POSITIVES:
            model.thresholds[name] = threshold(logits[mine], y[checked][mine])
    return model


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut of best accuracy on either class alike, in the middle of its gap and drawn halfway to even odds within it."""
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    caught = (t.sum() - np.concatenate(([0], np.cumsum(t)))) / t.sum()
    cleared = np.concatenate(([0], np.cumsum(1 - t))) / (1 - t).sum()
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    merit = caught + 1.5 * cleared
    best = np.flatnonzero(merit >= merit.max() - 1e-9)
    return float(edges[best[len(best) // 2]])


def held_out(key: str | Column = "doc_id") -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_A_CLASS) -> Model:
    """Fit on at most ``sample`` labelled rows of either class, never on held-out ids.

    The sample is the rows of smallest seeded hash in each class, found by a distributed top-k; their
    whole texts are hashed in the tasks that read them.  The driver gets integers of the sample only.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).cast("int").alias("y"))
    draw = lambda c: known.where(F.col("y") == c).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(5)), key).limit(sample)
    chosen = F.broadcast(draw(0).unionByName(draw(1)))  # 2 * sample rows at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[int]] = {}
        for batch in batches:
            out, spoken = [], []
            for t in batch.column(2):
                words = _tokens((t.as_py() or "").lower())
                if len(memory) > REMEMBERED:
                    memory.clear()
                for w in set(words).difference(memory):
                    memory[w] = features(w)
                out.append(np.array([memory[w] for w in words], np.int32).tobytes())
                spoken.append(language(votes(words).sum(axis=0), len(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(spoken)], ["id", "y", "x", "lang"])

    picked = docs.join(chosen, key).select(F.col(key).cast("string").alias("id"), "y", F.col(text).alias("t"))
    rows = in_small_batches(picked).mapInArrow(hashed, "id string, y int, x binary, lang string").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    texts = [np.frombuffer(x, np.int32).reshape(-1, FEATURES) for x in rows["x"].to_pylist()]
    return fit(texts, np.array(rows["y"].to_pylist(), np.int64), rows["lang"].to_pylist())


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, calibrated so that 0.5 is the threshold of the text's language) and ``predicted``.

    Whole texts are scored, long ones in steps that overlap by the widest filter, so no window is lost.
    Null and empty texts get the score of a text without evidence.  Clashing column names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.columns if f not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        project, over = m.projection(), max(WIDTHS) - 1
        index: dict[str, int] = {}
        width = project.shape[1]
        rows = np.zeros((0, width + len(_LANGUAGES)), np.float32)
        for batch in batches:
            scores = []
            for t in batch.column(batch.schema.get_field_index(text)):
                words = _tokens((t.as_py() or "").lower())
                if len(index) > REMEMBERED:
                    index.clear()
                if new := [w for w in set(words) if w not in index]:
                    used = len(index)
                    index.update((w, used + i) for i, w in enumerate(new))
                    if len(index) > len(rows):
                        rows = np.concatenate((rows[:used], np.zeros((len(new) + len(index) // 2, rows.shape[1]), np.float32)))
                    rows[used : used + len(new), :width] = m.table[np.array([features(w) for w in new])].sum(axis=1) @ project
                    rows[used : used + len(new), width:] = votes(new)
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                part = rows[at[:STEP]]
                pooled, said = m.pooled(part, last=len(at) <= STEP), part[:, width:].sum(axis=0)
                for i in range(STEP, len(at), STEP):
                    part = rows[at[i - over : i + STEP]]
                    pooled, said = np.maximum(pooled, m.pooled(part, first=False, last=i + STEP >= len(at))), said + part[over:, width:].sum(axis=0)
                scores.append(m.score(m.logit(pooled), language(said, len(words))))
            s = np.array(scores)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*kept, "score", "predicted"])

    return in_small_batches(docs.select(*kept)).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
