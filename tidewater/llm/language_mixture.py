"""Language ID by multilingual mixture inference.

Every language is a smoothed multinomial over hashed byte trigrams.  A document
is a mixture of languages: expectation-maximisation estimates the proportions
from the trigram likelihoods, and the set of languages is the one with the best
penalised likelihood (log likelihood minus ``penalty * log(trigrams)`` for each
language beyond the first), found by backward elimination.

EM steps are lengthened (each factor to a growing power) as long as the
likelihood grows, and run until the log likelihood is within ``tolerance`` of its maximum: the
likelihood is concave in the proportions, so its largest partial derivative
less the number of trigrams bounds what further steps can gain.  It also ends
once that bound shows that neither this set nor a subset of it can win.

Defined results:

* null text or a text without any letter: language ``und``, score 0.0;
* a text with letters but without usable trigrams cannot occur, since a single
  letter is padded by a space on both sides;
* no labelled row to learn from (empty table): every text is ``und``;
* rows with a null ``lang`` or null ``text`` teach nothing; a null ``doc_id``
  is not held out; of rows that share lang and doc_id the smallest text teaches;
* digits, numbers such as "½" or "Ⅷ" and marks are no letters;
* texts are always read whole; only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.shared import release_memory

#: Hashed trigram space.
DIM = 1 << 16
UNDETERMINED = "und"

_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
    for b in range(256)
)
_HAS_LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of a whole text and their counts.

    Letters only: ASCII non-letters become spaces; trigrams with two adjacent
    spaces carry nothing and are left out.
    """
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, mid, last = b[:-2], b[1:-1], b[2:]
    key = (first << np.uint32(16)) | (mid << np.uint32(8)) | last
    key = key[~((mid == 32) & ((first == 32) | (last == 32)))]
    hashed = (key * np.uint32(2654435761)) >> np.uint32(16)
    counts = np.bincount(hashed, minlength=DIM)
    found = np.flatnonzero(counts)
    return found, counts[found]


class MixtureModel:
    """Log probabilities of trigrams by language, and inference on one text."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.5, penalty: float = 4.0, tolerance: float = 0.05):
        """*counts*: one row of DIM trigram counts for each language."""
        self.langs, self.penalty, self.tolerance = list(langs), penalty, tolerance
        smoothed = counts.astype(np.float64) + alpha
        self.prob = np.ascontiguousarray((smoothed / smoothed.sum(axis=1, keepdims=True)).T) if langs else np.zeros((DIM, 0))
        self.log_prob = np.log(self.prob)

    def _em(self, like: np.ndarray, c: np.ndarray, n: float, hopeless: float) -> tuple[np.ndarray, float] | None:
        """Proportions of the languages in *like*'s columns and the log
        likelihood; None once that cannot come above *hopeless*."""
        pi = np.full(like.shape[1], 1.0 / like.shape[1])
        reach, before, plain = 1.0, -np.inf, pi
        while True:
            mixed = like @ pi
            ll = float(c @ np.log(mixed))
            if ll < before:  # the longer step was too long: take the plain one
                pi, reach, before = plain, 1.0, -np.inf
                continue
            slope = like.T @ (c / mixed)
            gain = float(slope.max()) - n
            if ll + gain <= hopeless:
                return None
            if gain <= self.tolerance:
                return pi, ll
            plain = pi * slope / n
            pi = np.maximum(pi * (slope / n) ** reach, 1e-300)
            pi, before, reach = pi / pi.sum(), ll, 1.5 * reach

    def proportions(self, text: str | None) -> dict[str, float]:
        """Proportion of each language of the selected set; empty for ``und``."""
        if text is None or not self.langs or not _HAS_LETTER.search(text):
            return {}
        grams, c = trigrams(text)
        if not len(grams):
            return {}
        c = c.astype(np.float64)
        n, single = c.sum(), c @ self.log_prob[grams]
        best = int(np.argmax(single))
        chosen, best_score = np.array([best]), float(single[best])
        best_pi = np.ones(1)
        price = self.penalty * np.log(n + 1.0)
        members = np.arange(len(self.langs))
        like = self.prob[grams]
        while len(members) > 1:
            found = self._em(like[:, members], c, n, best_score + price)
            if found is None:  # no subset of these has a better likelihood, and all but one language cost
                break
            pi, ll = found
            if ll - price * (len(members) - 1) > best_score:
                chosen, best_pi, best_score = members, pi, ll - price * (len(members) - 1)
            members = np.delete(members, int(np.argmin(pi)))
        return {self.langs[k]: float(p) for k, p in zip(chosen, best_pi / best_pi.sum())}

    def predict(self, text: str | None) -> tuple[str, float]:
        mix = self.proportions(text)
        if not mix:
            return UNDETERMINED, 0.0
        lang = min(mix, key=lambda k: (-mix[k], k))
        return lang, min(1.0, mix[lang])


def _count_trigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            if text is not None and lang is not None:
                grams, c = trigrams(text)
                totals.setdefault(lang, np.zeros(DIM, np.int64))[grams] += c
        release_memory()
    for lang, row in totals.items():
        found = np.flatnonzero(row)
        yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": row[found]})


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows_per_lang: int = 2048, salts: int = 64) -> DataFrame:
    """lang, text of at most *rows_per_lang* labelled rows of each language: the
    ids with the smallest hashes in each of ``salts`` hash buckets (so a language
    with a third of all rows is never gathered in one task), one row of each."""
    labelled = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = labelled.distinct().select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(salts)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    chosen = keyed.withColumn("place", place).where(F.col("place") <= max(1, rows_per_lang // salts)).select("lang", "doc_id")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
    return rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, rows_per_lang: int = 2048, salts: int = 64, **options) -> MixtureModel:
    """Learn trigram counts from the bounded :func:`sample` of labelled rows.

    Its ids are a table of at most ``rows_per_lang`` rows for each language; the
    model itself has DIM counts for each language, the only thing that reaches
    the driver."""
    rows = sample(docs, rows_per_lang, salts)
    counted = rows.mapInPandas(_count_trigrams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), DIM), np.int64)
    if len(found):
        counts[np.searchsorted(np.array(langs, dtype=object), found["lang"].to_numpy(dtype=object)), found["gram"].to_numpy()] = found["n"].to_numpy()
    return MixtureModel(langs, counts, **options)


def predictor(spark: SparkSession, model: MixtureModel):
    """A column function: text -> struct(lang, score).  The model, about a
    megabyte a language, is a broadcast variable, sent once to each executor."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [shared.value.predict(t) for t in texts]
        release_memory()
        return pd.DataFrame({"lang": [x[0] for x in out], "score": [x[1] for x in out]}, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of *docs*."""
    p = predictor(docs.sparkSession, model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p(F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Rows of *docs*, all columns as they are, whose language is determined and
    dominant (score of at least *min_score*); the others go."""
    p = predictor(docs.sparkSession, fit(docs))
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), p(docs["text"]).alias("p"))
    return judged.where((F.col("p.lang") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("row.*")
