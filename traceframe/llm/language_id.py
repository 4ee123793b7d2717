"""Language identification of documents that may mix languages.

Training counts, over every labelled training document, hashed character trigrams of words by language. A word's
likelihood under a language is the product over its trigrams; a document is a mixture in which each word
belongs to one language. Expectation-maximisation estimates the document's proportions over all
languages; then languages are taken out, smallest share first, as long as the penalised log-likelihood
(``penalty`` times the log of the number of words for each further language) does not fall. What remains is the language set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import U64, fold, in_slices

BUCKETS = 1 << 16
UNDETERMINED = "und"
#: Characters looked at together; the arrays take some 100 bytes for each.
SLICE = 1 << 20


#: Planes 0 to 3; no later one holds letters.
LETTERS = 0x40000


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(LETTERS)] + [False], dtype=bool)


def words_of(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the lower-cased texts: bucket of each trigram, the first trigram of each word, and each word's text.

    A word is a run of letters with a blank on both sides, so a word of n letters has n trigrams.
    """
    # A text apart is never part of the next one's words: a blank lies between.
    joined = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le"), dtype=np.uint32)
    inside = letters[np.minimum(codes, LETTERS)]
    codes = np.where(inside, codes, 0).astype(U64)
    at = np.flatnonzero(inside)
    h = (codes[at - 1] * U64(0x9E3779B97F4A7C15) + codes[at]) * U64(0xC2B2AE3D27D4EB4F) + codes[at + 1] if len(at) else np.zeros(0, dtype=U64)
    h = h * U64(0xBF58476D1CE4E5B9)
    grams = (h >> U64(48)).astype(np.int64)
    first = np.flatnonzero(~inside[at - 1]) if len(at) else at
    ends = np.cumsum([len(t) for t in joined])
    return grams, first, np.searchsorted(ends, at[first], side="right") if len(at) else at


def parts(text: str, size: int = SLICE) -> list[str]:
    """A long text in parts of about ``size`` characters, cut at blanks where there are any."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + size // 2, start + size) + 1 or start + size
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def count_grams(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all texts; a task sends at most one row per language and bucket."""

    def count(batches):
        letters, totals = letter_table(), {}
        for part in in_slices(batches, limit=SLICE):
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            texts = part.column(0).to_pylist()
            for name in set(langs.tolist()):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                totals.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for some in [own] if len(own) > 1 else [[p] for p in parts(own[0])]:
                    totals[name] += np.bincount(words_of(some, letters)[0], minlength=BUCKETS)
        for name, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["lang", "bucket", "n"]
            )

    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("text", F.col(lang).alias("lang"))
    rows = rows.mapInArrow(count, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods by bucket and language; its size is buckets times languages."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        total = counts.sum(axis=0) + smoothing * counts.shape[0]
        self.logs = np.log((counts + smoothing) / total).astype(np.float32)

    def words(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word under each language, and each word's text."""
        if len(texts) == 1 and len(texts[0]) > SLICE:
            logs = np.concatenate([self.words([p], letters)[0] for p in parts(texts[0])])
            return logs, np.zeros(len(logs), dtype=np.int64)
        grams, first, owner = words_of(texts, letters)
        if not len(first):
            return np.zeros((0, len(self.names)), dtype=np.float64), owner
        return np.add.reduceat(self.logs[grams], first, axis=0, dtype=np.float64), owner


def fit(docs: DataFrame, lang: str = "lang", most_languages: int = 256) -> Model | None:
    """The model of the labelled rows given; None without any. The driver gets the bucket counts, bounded by
    2^16 buckets times ``most_languages``; more distinct labels than that are an error."""
    table = count_grams(docs, lang)
    names = [r["lang"] for r in table.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not names:
        return None
    names = sorted(names)
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    cells = table.toPandas()
    counts[cells["bucket"].to_numpy(), cells["lang"].map(at).to_numpy()] = cells["n"].to_numpy()
    return Model(names, counts)


def mixture(likelihood: np.ndarray, chosen: list[int], rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages and the log-likelihood, by expectation-maximisation.

    ``likelihood`` is relative to the best language of each word.
    """
    own = likelihood[:, chosen]
    share = np.full(len(chosen), 1 / len(chosen))
    value = -np.inf
    for _ in range(rounds):
        mixed = own @ share
        now = float(np.log(mixed).sum())
        if now - value < 1e-3:
            break
        value = now
        share *= (own.T @ (1 / mixed)) / len(own)
    return share, float(np.log(own @ share).sum())


def select_languages(logs: np.ndarray, penalty: float, rounds: int) -> tuple[dict[int, float], float]:
    """The language set with its proportions, and the certainty of its largest member.

    The certainty is the member's proportion, or for one language alone its posterior among single ones.
    """
    top = logs.max(axis=1, keepdims=True)
    likelihood = np.exp(np.maximum(logs - top, -60.0))
    single = np.maximum(logs - top, -60.0).sum(axis=0)
    best = int(single.argmax())
    cost = penalty * np.log(1 + len(logs))
    # No mixture is better than each word under its own best language.
    if -single[best] > cost:
        chosen = list(range(logs.shape[1]))
        share, value = mixture(likelihood, chosen, rounds)
        while len(chosen) > 1:
            if len(chosen) == 2:
                fewer = [max(chosen, key=lambda k: single[k])]
                less, rest = float(single[fewer[0]]), np.ones(1)
            else:
                fewer = [k for i, k in enumerate(chosen) if i != int(share.argmin())]
                rest, less = mixture(likelihood, fewer, rounds)
            if value - less > cost:
                break
            chosen, share, value = fewer, rest, less
        if len(chosen) > 1:
            result = {k: float(s) for k, s in zip(chosen, share)}
            return result, max(result.values())
        best = chosen[0]
    return {best: 1.0}, float(1 / np.exp(np.minimum(single - single[best], 60.0)).sum())


class Predictor:
    """Predictions for lists of texts: language, score and language set of each."""

    def __init__(self, model: Model | None, penalty: float, rounds: int):
        self.model, self.penalty, self.rounds, self.letters = model, penalty, rounds, letter_table()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[str]]:
        names, scores, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
        m = self.model
        if m is not None:
            logs, owner = m.words([t or "" for t in texts], self.letters)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                if cuts[i + 1] > cuts[i]:
                    found, scores[i] = select_languages(logs[cuts[i] : cuts[i + 1]], self.penalty, self.rounds)
                    ranked = sorted(found.items(), key=lambda x: (-x[1], m.names[x[0]]))
                    names[i] = m.names[ranked[0][0]]
                    sets[i] = ",".join(f"{m.names[k]}:{s:.3f}" for k, s in ranked)
        return names, scores, sets


def identify(docs: DataFrame, model: Model | None, penalty: float = 3.0, rounds: int = 30) -> DataFrame:
    """doc_id, lang_pred, score, languages (name:share by falling share) for every row.

    A null text or one without letters is ``und`` with score 0, as is every text if the model is None.
    Rows with a null or repeated id keep a row each; nothing but the text decides.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        predictor = Predictor(shared.value, penalty, rounds)
        for part in in_slices(batches, limit=SLICE):
            names, scores, sets = predictor(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, languages string")


def annotate(docs: DataFrame, model: Model | None, penalty: float = 3.0, rounds: int = 30) -> DataFrame:
    """The rows whose text has a language, with the same columns; a null ``lang`` is filled with the prediction.

    Dropped are null texts, texts without letters, and all texts if there is no model.
    """
    shared, at, lang = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches):
        predictor = Predictor(shared.value, penalty, rounds)
        for part in in_slices(batches, limit=SLICE):
            names = predictor(part.column(at).to_pylist())[0]
            filled = [old if old is not None else new for old, new in zip(part.column(lang).to_pylist(), names)]
            part = part.set_column(lang, part.schema.field(lang), pa.array(filled, part.schema.field(lang).type))
            yield part.filter(pa.array([n != UNDETERMINED for n in names], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def training_rows(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    return docs.where((fold("doc_id", folds) != held) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
