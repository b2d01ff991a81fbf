"""Language identification in two steps: the family first, then the language within it.

Both steps are linear support vector machines over hashed character n-grams. Families are told apart one against the
rest; the languages of one family by a machine for each two of them, whose votes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, slices

# Language families by ISO 639-1 code. A language that isn't named here is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
FEATURES = 4096
_CHUNK = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str | None, features: int = FEATURES) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of the whole text's letters, lower-cased, all else as a space; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    whole = np.zeros(len(points) + 2, np.uint32)
    np.copyto(whole[1:-1], points, where=letter)
    counts = np.zeros(features, np.int64)
    for at in range(0, len(whole), _CHUNK):  # long texts in chunks, each with the two signs after it
        codes = whole[at : at + _CHUNK + 2].astype(np.uint64)
        one = codes[:_CHUNK]
        two = codes[:-1][:_CHUNK] * np.uint64(0x110000) + codes[1:][:_CHUNK]
        three = two[: len(codes) - 2] * np.uint64(0x110000) + codes[2:]
        for k, grams, some in ((1, one, one > 0), (2, two, two > 0), (3, three, codes[1:-1] > 0)):
            counts += np.bincount((mix(grams[some], k) >> np.uint64(40)).astype(np.int64) % features, minlength=features)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + c * mean squared hinge, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # both sides weigh the same
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), 1 / (1 + 4 * c)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        nxt = ahead - rate * (ahead - 2 * c * (x.T @ (each * y * slack)))
        ahead = nxt + (t / (t + 3)) * (nxt - w)
        w = nxt
    return w


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.lower().split("-")[0] in v), lang)


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(k) for k in self.langs})
        own, of = np.array(langs), np.array([family_of(k) for k in langs])
        self.family = np.array([linear_svm(x, np.where(of == k, 1, -1).astype(np.float32)) for k in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for k in self.families:
            for a, b in combinations([i for i in self.langs if family_of(i) == k], 2):
                some = (own == a) | (own == b)
                self.pairs[a, b] = linear_svm(x[some], np.where(own[some] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of scaled feature rows."""
        chance = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family.T if self.family is not None else np.ones((len(x), 1))
        best = margins.argmax(axis=1)
        between = {k: x @ w for k, w in self.pairs.items()}
        names, scores = [], np.empty(len(x))
        for i, f in enumerate(best):
            langs = [k for k in self.langs if family_of(k) == self.families[f]]
            votes = {k: (0, 0.0) for k in langs}
            for a, b in combinations(langs, 2):
                m = float(between[a, b][i])
                for k, v in ((a, m), (b, -m)):
                    votes[k] = (votes[k][0] + (v > 0), votes[k][1] + v)
            name = max(langs, key=lambda k: votes[k])
            own = [between[a, b][i] * (1 if a == name else -1) for a, b in combinations(langs, 2) if name in (a, b)]
            names.append(name)
            scores[i] = chance(margins[i, f]) * (min(chance(np.array(own))) if own else 1.0)
        return names, scores


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that models never learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = 500) -> LanguageModel | None:
    """Learns from at most per_language documents of each language, those with the least hashed doc_id, outside the
    held-out fifth. Only these come to the driver, as sparse counts. None if no document has a language.

    Ranks are made in 16 parts of a language first, so that one that most documents have isn't ranked in one task."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    chosen = learn.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(16)))
    for keys in (["lang", "part"], ["lang"]):
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("rank") <= per_language).drop("rank")
    chosen = chosen.select("doc_id", "lang").distinct()
    sample = learn.join(F.broadcast(chosen), ["doc_id", "lang"])  # bound: per_language rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, much, langs, ids = [], [], [], []
            for doc_id, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = ngram_counts(text)
                if counts is not None:
                    at.append(np.flatnonzero(counts).tolist())
                    much.append(counts[at[-1]].tolist())
                    langs.append(lang)
                    ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(much, pa.list_(pa.int32()))], names=["doc_id", "lang", "at", "much"])

    rows = sample.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, much array<int>").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not rows.num_rows:
        return None
    x = np.zeros((rows.num_rows, FEATURES), np.int32)
    for i, (at, much) in enumerate(zip(rows["at"], rows["much"], strict=True)):
        x[i, at.values.to_numpy()] = much.values.to_numpy()
    return LanguageModel(scaled(x), rows["lang"].to_pylist())


def _predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    counts = [ngram_counts(x) for x in texts]
    names, scores = ["und"] * len(counts), np.zeros(len(counts))
    some = [i for i, x in enumerate(counts) if x is not None]
    if some and model is not None:
        found, sure = model.predict(scaled(np.array([counts[i] for i in some])))
        for i, name, score in zip(some, found, sure, strict=True):
            names[i], scores[i] = name, score
    return names, scores


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text alone.

    Null and empty texts and texts without a letter get `und` and score 0, as do all texts if nothing could be learned.
    Repeated rows get equal results. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = _predict(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang replaced by the prediction; null or letterless texts get `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, text = docs.columns.index("lang"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, _ = _predict(shared.value, batch.column(text).to_pylist())
            yield batch.set_column(at, "lang", pa.array(names, pa.string()))

    return docs.mapInArrow(run, docs.schema)
