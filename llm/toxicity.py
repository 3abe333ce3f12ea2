"""Toxicity by a convolutional text classifier trained in numpy.

Words are embedded through two hash functions, one of the word and one of its first letters (rows added),
convolved with filters of several widths, max-pooled over the whole text and weighed by a logistic output.
All weights start at random; training follows only the positions that won the pooling, so its gradients are
sparse.  Logits are calibrated per language, which a model of character n-grams (see ``langid``) reads off
the text itself; after calibration every language's threshold lies at 0.3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import langid
from .common import chunks, small_batches, split_of, table, text_bytes, trim
from .training import labelled, sample

BITS, WIDTH, DIM, FILTERS, SIZES = 18, 1 << 18, 8, 12, (1, 2, 3)
THRESHOLD = 0.3
#: Labelled rows of each class that fit a model, and rows of each language that fit the one of languages.
PER_CLASS, PER_LANGUAGE = 3000, 100
#: Letters of a word's second embedding, updates of the weights, and texts of an update.
STEM, STEPS, BATCH = 5, 600, 64
#: Toxic rows of a language that weigh as much as all languages together in its threshold.
PRIOR = 30
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_/\\~`^+="


class WordCodes(dict):
    """Of each word: the rows of its letters and of its first ``STEM`` letters, packed into one integer."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = (word.strip(EDGES) or word).decode("utf-8", "replace").lower()
        own, stem = xxhash.xxh3_64_intdigest(core.encode()), xxhash.xxh3_64_intdigest(core[:STEM].encode(), 1)
        value = self[word] = (own & (WIDTH - 1)) | (stem & (WIDTH - 1)) << BITS
        return value


def codes_of(texts: list[bytes | None], known: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in turn, and the number of words of each text; a text without words has one empty word."""
    words, counts = [], np.ones(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or b"").lower().split() or [b""]
        counts[i] = len(own)
        words += own
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), counts


def rows_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes & (WIDTH - 1), codes >> BITS & (WIDTH - 1)


def languages_of(model: dict, texts: list[bytes | None], words: langid.WordMargins) -> np.ndarray:
    """Number of each text's language in ``model["languages"]``; their count for all others."""
    if not model["languages"]:
        return np.zeros(len(texts), np.int64)
    names, _ = langid.decide(model["language_model"], words.sums([t.decode("utf-8", "replace") if t else None for t in texts]))
    place = {name: i for i, name in enumerate(model["languages"])}
    return np.array([place.get(name, len(place)) for name in names], np.int64)


def product(x: np.ndarray, w: np.ndarray, block: int = 256) -> np.ndarray:
    """x @ w in blocks of rows, too small for the linear algebra library to start threads for."""
    whole = len(x) // block * block
    out = np.empty((len(x), w.shape[1]), np.float32)
    np.matmul(x[:whole].reshape(-1, block, x.shape[1]), w, out=out[:whole].reshape(-1, block, w.shape[1]))
    out[whole:] = x[whole:] @ w
    return out


def activations(model: dict, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embedded words with ``max(SIZES) - 1`` zero rows after each text, and per width the filters' values at each position.

    Windows start at words; those that would start after a text's last word, and reach into the next text, never win.
    """
    pad = max(SIZES) - 1
    a, b = rows_of(codes)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(counts)) * pad, counts)
    x = np.zeros((len(codes) + pad * len(counts) + pad, DIM), np.float32)
    x[at] = model["e1"][a] + model["e2"][b]
    n = len(x) - pad
    after = np.ones(n, bool)
    after[at] = False
    found = []
    for k, size in enumerate(SIZES):
        value = product(x, model["w"][k][0])[:n]
        for j in range(1, size):
            value += product(x, model["w"][k][j])[j : n + j]
        value[after] = -1e30
        found.append(value)
    return x, found


def logits(model: dict, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    pad = max(SIZES) - 1
    starts = np.concatenate([[0], np.cumsum(counts + pad)[:-1]])
    _, found = activations(model, codes, counts)
    pooled = [np.maximum(np.maximum.reduceat(v, starts, axis=0) + model["b"][k], 0) for k, v in enumerate(found)]
    return np.concatenate(pooled, 1) @ model["out"] + model["bias"]


def without_rare(codes: np.ndarray, counts: np.ndarray, least: int = 3) -> np.ndarray:
    """Codes with those rows that fewer than ``least`` texts use replaced by the empty word's: what they teach doesn't carry over."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros_like(codes)
    for k, (rows, blank) in enumerate(zip(rows_of(codes), rows_of(np.array([WordCodes()[b""]])), strict=True)):
        texts = np.bincount(np.unique(owner * WIDTH + rows) % WIDTH, minlength=WIDTH)
        out |= np.where(texts[rows] < least, blank[0], rows) << (k * BITS)
    return out


def new_model(draw) -> dict:
    return {
        "e1": draw.normal(0, 0.01, (WIDTH, DIM)).astype(np.float32), "e2": draw.normal(0, 0.01, (WIDTH, DIM)).astype(np.float32),
        "w": [draw.normal(0, 1 / np.sqrt(s * DIM), (s, DIM, FILTERS)).astype(np.float32) for s in SIZES],
        "b": [np.zeros(FILTERS, np.float32) for _ in SIZES], "out": draw.normal(0, 0.3, FILTERS * len(SIZES)).astype(np.float32), "bias": np.float32(-1.0),
    }


def fit_network(codes: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 1, steps: int = STEPS, batch: int = BATCH, rate: float = 0.05) -> dict:
    """Logistic loss with balanced classes, by Adagrad over batches of whole texts; ``steps`` updates, in whole epochs."""
    draw = np.random.default_rng(seed)
    model = new_model(draw)
    starts = np.concatenate([[0], np.cumsum(counts)])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    seen = {k: np.full(v.shape, 0.1, np.float32) if not isinstance(v, list) else [np.full(u.shape, 0.1, np.float32) for u in v] for k, v in model.items() if k not in ("e1", "e2", "bias")}
    seen |= {"e1": np.full(WIDTH, 0.1, np.float32), "e2": np.full(WIDTH, 0.1, np.float32), "bias": 0.1}
    pad = max(SIZES) - 1

    def step(name, grad, k=None):
        value, total = (model[name], seen[name]) if k is None else (model[name][k], seen[name][k])
        total += grad * grad
        value -= rate * grad / np.sqrt(total)

    batches = max(1, len(y) // batch)
    for _ in range(-(-steps // batches)):
        for rows in np.array_split(draw.permutation(len(y)), batches):
            own = np.concatenate([codes[starts[r] : starts[r + 1]] for r in rows])
            x, found = activations(model, own, counts[rows])
            at = np.concatenate([[0], np.cumsum(counts[rows] + pad)])
            where = [np.stack([v[at[i] : at[i + 1]].argmax(0) + at[i] for i in range(len(rows))]) for v in found]
            raw = [np.take_along_axis(v, p, 0) + model["b"][k] for k, (v, p) in enumerate(zip(found, where, strict=True))]
            pooled = np.maximum(np.concatenate(raw, 1), 0)
            z = pooled @ model["out"] + model["bias"]
            slope = (weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            back = (slope[:, None] * model["out"]) * (pooled > 0)
            step("out", pooled.T @ slope + 1e-4 * model["out"])
            seen["bias"] += slope.sum() ** 2
            model["bias"] = np.float32(model["bias"] - rate * slope.sum() / np.sqrt(seen["bias"]))
            index = np.full(len(x), -1, np.int64)
            index[np.arange(len(own)) + np.repeat(np.arange(len(rows)) * pad, counts[rows])] = np.arange(len(own))
            moved, pulls = [], []
            for k, size in enumerate(SIZES):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                step("b", g.sum(0), k)
                grad = np.zeros_like(model["w"][k])
                for j in range(size):
                    spot = where[k] + j
                    grad[j] = np.einsum("if,ifd->df", g, x[spot])
                    moved.append(index[spot].ravel())
                    pulls.append((g[:, :, None] * model["w"][k][j].T[None]).reshape(-1, DIM))
                step("w", grad + 1e-4 * model["w"][k], k)
            moved, pulls = np.concatenate(moved), np.concatenate(pulls)
            live = (moved >= 0) & (np.abs(pulls).sum(1) > 0)
            for name, all_rows in zip(("e1", "e2"), rows_of(own), strict=True):
                target, inverse = np.unique(all_rows[moved[live]], return_inverse=True)
                grad = np.stack([np.bincount(inverse, pulls[live, d], len(target)) for d in range(DIM)], 1).astype(np.float32)
                seen[name][target] += np.square(grad).mean(1)
                model[name][target] -= rate * grad / np.sqrt(seen[name][target])[:, None]
    return model


def calibrate(z: np.ndarray, y: np.ndarray, lang: np.ndarray, languages: int) -> np.ndarray:
    """(slope, threshold) of each language and of all others; the threshold has the best F1, ties to the middle of the gap."""

    def best(z, y):
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
        top = int(f1.argmax())
        low = z[order[top + 1]] if top + 1 < len(z) else z[order[top]] - 1
        return (z[order[top]] + low) / 2

    everyone = best(z, y) if y.any() and not y.all() else 0.0
    slope = 4.0 / max(1.0, float(np.std(z)) if len(z) else 1.0)
    out = np.full((languages + 1, 2), (slope, everyone))
    for i in range(languages):
        own = lang == i
        if y[own].any() and not y[own].all():
            n = y[own].sum()
            out[i, 1] = (n * best(z[own], y[own]) + PRIOR * everyone) / (n + PRIOR)
    return out


def held_logits(model: dict, texts: list[str], rows: np.ndarray, known: WordCodes) -> np.ndarray:
    return np.concatenate([logits(model, *codes_of([texts[i].encode() for i in own], known)) for own in np.array_split(rows, max(1, len(rows) // 200))])


def fit(texts: list[str], y: np.ndarray, langs: list[str | None] | None = None, seed: int = 1, steps: int = STEPS) -> dict:
    """A network on four fifths of the rows gives thresholds on the rest; one on all rows, trained alike, then scores with them.

    If the rest has fewer than five rows of label 1, all rows give the thresholds too.  ``langs`` only name the languages of the model that calibration asks; without them there is one threshold.
    """
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    by_language: dict[str, list[int]] = {}
    for i, name in enumerate(langs or []):
        if name is not None:
            by_language.setdefault(name, []).append(i)
    some = [i for name in sorted(by_language) for i in by_language[name][:PER_LANGUAGE]]
    asked = {"languages": sorted(by_language), "language_model": langid.fit([texts[i] for i in some], [langs[i] for i in some]) if some else None}
    known = WordCodes()
    coded = [codes_of([t.encode() for t in texts[i : i + 200]], known) for i in range(0, len(texts), 200)]
    codes, counts = (np.concatenate(x) for x in zip(*coded, strict=True))
    del coded
    codes = without_rare(codes, counts)
    fold = np.random.default_rng(seed).permutation(len(y)) % 5 == 0
    if y[fold].sum() < 5:
        fold[:] = False
    # What gives the thresholds is done with before the network on all rows is fitted, so the two never take memory together.
    rows = np.flatnonzero(fold if fold.any() else ~fold)
    trim()
    if fold.any():
        part = fit_network(codes[np.repeat(~fold, counts)], counts[~fold], y[~fold], seed, steps)
        z = held_logits(part, texts, rows, known)
        del part
        trim()
    model = fit_network(codes, counts, y, seed, steps)
    if not fold.any():
        z = held_logits(model, texts, rows, known)
    del codes, known
    trim()
    model |= asked
    words = langid.WordMargins(model["language_model"]) if some else None
    lang = np.concatenate([languages_of(model, [texts[i].encode() for i in own], words) for own in np.array_split(rows, max(1, len(rows) // 200))])
    model["calibration"] = calibrate(z, y[rows], lang, len(model["languages"]))
    return model


class Scorer:
    """Scores texts by a model and remembers the words it met."""

    def __init__(self, model: dict):
        self.model, self.known = model, WordCodes()
        self.words = langid.WordMargins(model["language_model"]) if model.get("language_model") else None

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        if "constant" in self.model:
            return np.full(len(texts), self.model["constant"])
        slope, threshold = self.model["calibration"][languages_of(self.model, texts, self.words)].T
        z = slope * (logits(self.model, *codes_of(texts, self.known)) - threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, condition, label: str = "toxic", per_class: int = PER_CLASS, steps: int = STEPS) -> dict:
    """A model of the labels of rows that meet ``condition``; rows without a label of 0 or 1, or without an id, teach nothing."""
    extra = tuple(c for c in ("lang",) if c in docs.columns)
    trim()  # an earlier model's training may have left memory that is free
    rows, _ = sample(docs, labelled(docs, labels, label, condition), per_class, extra=extra)
    langs = [x if isinstance(x, str) else None for x in rows["lang"]] if extra else None
    texts, toxic = rows["text"].tolist(), (rows["y"] == "1").to_numpy().astype(int)
    del rows
    trim()
    return fit(texts, toxic, langs, steps=steps)


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs``, all columns, with a score of every whole text; null texts are scored as empty ones, equal texts get equal scores.

    Without labelled rows of both classes the score is the share of label 1 (0 without any).
    Only ``text`` is read; a column that is called ``name`` already is replaced.  Repeated rows are scored each
    for itself, rows with a null doc_id like any others.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)

    def run(batches):
        score = Scorer(shared.value)
        for batch in chunks(batches, "text", 1 << 20):
            found = score(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = split_of("doc_id", 4) == 2
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    return with_score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
