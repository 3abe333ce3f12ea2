"""Language identification by hierarchical discrimination.

A first set of linear support vector machines tells language families apart; one-versus-one machines
then separate the languages of the family.  Languages of unknown families make families by the likeness of their
texts if they are many, and many families are told each from the rest, so the number of machines grows with that of
the languages and not with its square.  Features are frequencies of hashed character n-grams inside
words, so a text's margin is the mean of those of its n-grams: each word is scored once and looked up
from then on.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, split_of, table
from .training import CLASS_BYTES, sample

#: Families by language code; a code of no family here is a family of its own, or of one with those most like it if there are many.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "east_asian": "ja ko zh",
}
LETTERS = re.compile(r"[^\W\d_]+")
BITS, ORDERS = 13, (1, 2, 3, 4)
#: Rows that fit a model: this many of a language, and this many in all, but four of each language at least.
PER_LANGUAGE, MOST_ROWS = 500, 4000
#: Families up to which these are told apart pair by pair, and languages of a family made of unknown codes.
MANY, RELATED = 10, 8
#: Bytes of text that fit a model of many languages.
ALL_BYTES = 512 << 20
#: Margins that a worker keeps.
KEPT = 1_200_000


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"own:{code}")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; fractions, raised digits and the like, which a pattern takes for word characters, are none."""
    words = LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, marked at their borders, and where each word's begin (no word is empty)."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, owners, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        inside = owner[: len(h)] == owner[n - 1 :]
        keys.append((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS))
        owners.append(owner[: len(h)][inside])
    keys, owners = np.concatenate(keys).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(words)))


def gram_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        if words := words_of(text):
            out[i] = np.bincount(word_grams(words)[0], minlength=1 << BITS)
            out[i] /= out[i].sum()
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 100.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge machine with balanced classes, by accelerated gradient descent; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    vw, vb, t = w.copy(), b, 1.0
    norm = float(np.square(x).sum(1).max()) + 1
    rate = 1.0 / (1.0 + 2 * c * norm * 0.5)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw.astype(np.float32) + vb))
        pull = (2 * weight * slack * y).astype(np.float32)
        nw, nb = vw - rate * (vw - x.T @ pull), vb + rate * float(pull.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, float(b)


def rest_machines(x: np.ndarray, who: np.ndarray, options: list[str], c: float = 100.0, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """``linear_svm`` of each option against all others, all in one descent."""
    y = np.where(who[:, None] == np.array(options)[None, :], 1.0, -1.0).astype(np.float32)
    weight = (np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(0)), 0.5 / np.maximum(1, (y < 0).sum(0))) * c).astype(np.float32)
    w, b = np.zeros((x.shape[1], len(options)), np.float32), np.zeros(len(options), np.float32)
    vw, vb, t = w.copy(), b.copy(), 1.0
    rate = np.float32(1.0 / (1.0 + c * (float(np.square(x).sum(1).max()) + 1)))
    for _ in range(steps):
        pull = 2 * weight * np.maximum(0, 1 - y * (x @ vw + vb)) * y
        nw, nb = vw - rate * (vw - x.T @ pull), vb + rate * pull.sum(0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb, w, b, t = nw + np.float32((t - 1) / nt) * (nw - w), nb + np.float32((t - 1) / nt) * (nb - b), nw, nb, nt
    return w, b


def likeness_groups(names: list[str], means: np.ndarray, most: int = RELATED) -> list[list[str]]:
    """Names in groups of at most ``most``, halved again and again along the direction in which their means differ most."""
    if len(names) <= most:
        return [names]
    centred = means - means.mean(0)
    gram = centred @ centred.T
    order = np.argsort(np.linalg.eigh(gram)[1][:, -1], kind="stable")
    half = len(names) // 2
    return [g for part in (order[:half], order[half:]) for g in likeness_groups([names[i] for i in part], means[part], most)]


def fit(texts: list[str], langs: list[str], seed: int = 3) -> dict:
    """Family machines and one-versus-one machines within each family, as one weight matrix over n-grams."""
    draw = np.random.default_rng(seed)
    short = []
    for text in texts:  # short excerpts too, so that short texts are told apart as well
        words = text.split()
        at = int(draw.integers(0, max(1, len(words) - 8)))
        short.append(" ".join(words[at : at + int(draw.integers(3, 15))]))
    x = gram_counts(list(texts) + short)
    y = np.array(list(langs) * 2)
    x, y = x[x.sum(1) > 0], y[x.sum(1) > 0]
    names = sorted(set(y.tolist()))
    scale = (1 / np.sqrt(x.mean(0) + 1e-4)).astype(np.float32) if len(x) else np.ones(1 << BITS, np.float32)
    x *= scale
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family_of(name), []).append(name)
    if len(groups) > MANY:
        alone = sorted(name for family, own in groups.items() if family.startswith("own:") for name in own)
        groups = {f: own for f, own in groups.items() if not f.startswith("own:")}
        means = np.stack([x[y == name].mean(0) for name in alone])
        groups |= {f"own:{own[0]}": sorted(own) for own in likeness_groups(alone, means)}
    family = {name: f for f, own in groups.items() for name in own}
    families = np.array([family[v] for v in y.tolist()])
    at = {name: np.nonzero(y == name)[0] for name in names}
    duels, columns, biases = [], [], []
    if len(groups) > MANY:
        options = sorted(groups)
        rest, bias = rest_machines(x, families, options)
        duels += [("family", a, None) for a in options]
        columns += list((rest * scale[:, None]).astype(np.float32).T)
        biases += bias.tolist()
    else:
        for a, b in combinations(sorted(groups), 2):
            rows = (families == a) | (families == b)
            w, bias = linear_svm(x[rows], np.where(families[rows] == a, 1.0, -1.0))
            duels.append(("family", a, b))
            columns.append((w * scale).astype(np.float32))
            biases.append(bias)
    for own in groups.values():
        for a, b in combinations(own, 2):
            rows = np.sort(np.concatenate([at[a], at[b]]))
            w, bias = linear_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))
            duels.append(("lang", a, b))
            columns.append((w * scale).astype(np.float32))
            biases.append(bias)
    weights = np.stack(columns, 1) if columns else np.zeros((1 << BITS, 0), np.float32)
    return {"groups": groups, "duels": duels, "weights": weights, "biases": np.array(biases)}


class WordMargins:
    """The summed margins and the number of n-grams of every word seen, up to about ``kept`` numbers."""

    def __init__(self, model: dict, kept: int = KEPT):
        self.weights, self.limit = model["weights"], max(1000, kept // (model["weights"].shape[1] + 1))
        self.known, self.rows = {}, np.zeros((0, model["weights"].shape[1] + 1), np.float32)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        found = [words_of(t) if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.known, self.rows = {}, self.rows[:0]
        new = list({w for words in found for w in words if w not in self.known})
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            keys, starts = word_grams(part)
            counts = np.diff(np.append(starts, len(keys))).astype(np.float32)
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, np.column_stack([np.add.reduceat(self.weights[keys], starts, axis=0), counts])])
        out = np.zeros((len(texts), self.rows.shape[1]), np.float64)
        for i, words in enumerate(found):
            if words:
                out[i] = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out


def decide(model: dict, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score from summed margins; texts without letters are ``und`` with score 0."""
    grams = sums[:, -1:]
    margins = sums[:, :-1] / np.maximum(grams, 1) + model["biases"]
    chance = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
    groups = model["groups"]

    owner = {name: family for family, own in groups.items() for name in own}
    duels = defaultdict(list)
    for k, (level, a, b) in enumerate(model["duels"]):
        duels[level if level == "family" else owner[a]].append((k, a, b))

    def share(among: str, options: list[str], rows=slice(None)) -> np.ndarray:
        own = chance[rows]
        out, place = np.zeros((len(own), len(options))), {name: i for i, name in enumerate(options)}
        for k, a, b in duels[among]:
            out[:, place[a]] += np.log(own[:, k])
            if b is not None:
                out[:, place[b]] += np.log1p(-own[:, k] + 1e-13)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    names, scores = np.full(len(sums), "und", object), np.zeros(len(sums))
    lettered = grams[:, 0] > 0
    if groups:
        families = sorted(groups)
        by_family = share("family", families)
        pick = by_family.argmax(1)
        for f, family in enumerate(families):
            rows = np.nonzero((pick == f) & lettered)[0]
            if len(rows):
                within = share(family, groups[family], rows)
                best = within.argmax(1)
                names[rows] = np.array(groups[family], object)[best]
                scores[rows] = by_family[rows, f] * within[np.arange(len(rows)), best]
    return names.tolist(), np.clip(scores, 0, 1)


def train(docs: DataFrame, condition, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> dict:
    """A model of every value of ``lang`` among the rows that meet ``condition``, however many there are."""
    ids = docs.where(condition).select("doc_id", F.col("lang").cast("string").alias("y")).where("y IS NOT NULL")
    languages = ids.select("y").distinct().count()
    rows, _ = sample(docs, ids, max(4, min(per_language, most_rows // max(1, languages))), min(CLASS_BYTES, ALL_BYTES // max(1, languages)))
    return fit(rows["text"].tolist(), rows["y"].tolist())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; null texts and texts without a letter are ``und``, 0.

    Only doc_id and text are read, so further columns may have any name; repeated rows get equal results, and
    so do equal texts.  Of languages with equal scores the first by name is taken.  A null doc_id stays null;
    a model fitted on no rows calls every text ``und``.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = WordMargins(shared.value)
        for batch in chunks(batches, "text"):
            names, scores = decide(shared.value, words.sums(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = split_of("doc_id", 3) == 1
    model = train(docs, ~held)
    return identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
