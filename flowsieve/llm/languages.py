"""Languages of texts as mixtures.

Each language has a distribution over hashed n-grams (three-byte strings and words). A text is taken
as drawn from a mixture of these; expectation-maximisation estimates the proportions. Languages are
then taken out, the rarest first, as long as the log-likelihood falls by less than a penalty that
grows with the log of the number of n-grams; the remaining set is the text's, and its most frequent
language the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.textbytes import LETTERS_AND_DIGITS, LOWER, Chunk, mixed, text_chunks, words

BITS = 17
# Texts a language is learnt from, about: those whose hash is below the language's share. What is kept
# of them is a count per n-gram.
ROWS_PER_LANGUAGE = 5_000
SMOOTHING = 0.5
# N-grams overlap, so one counts as this part of an independent one.
INDEPENDENT = 0.25
PENALTY = 2.0
ROUNDS, SETTLED = 30, 1e-3
# Proportions below this are tried together as the first to go.
RARE = 0.05
UNKNOWN = "und"


@dataclass
class Model:
    """Languages in order, their shares, and per n-gram each one's probability over the highest's."""

    languages: list[str]
    shares: np.ndarray
    ratios: np.ndarray


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), ordered by text; A-Z count as a-z."""
    found = words(chunk, LETTERS_AND_DIGITS)
    data = LOWER[chunk.data].astype(np.uint64)
    triples = mixed(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:], 3)
    at = np.arange(len(triples))
    text = np.searchsorted(chunk.ends, at, "right")
    whole = at + 3 <= chunk.ends[np.minimum(text, len(chunk.ends) - 1)]
    value = np.concatenate([found.hash, triples[whole]]) >> np.uint64(64 - BITS)
    owner = np.concatenate([found.text, text[whole]])
    key, count = np.unique(owner.astype(np.int64) << BITS | value.astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def fit(documents: DataFrame, learnt: Column, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from the text and lang of documents for which ``learnt``, a condition on doc_id, holds.

    Rows without a lang or a text teach nothing. Of a language with more than ``rows`` documents, those
    with the smallest hashes of id and text are read, about ``rows`` of them. What reaches the driver is
    one count per language and n-gram.
    """
    known = documents.filter(learnt & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    held = {r["lang"]: r.n_rows for r in sizes.collect()}
    languages = sorted(held)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0), np.float32))
    number = documents.sparkSession.createDataFrame([(c, i, rows / held[c]) for i, c in enumerate(languages)], "lang string, number int, part double")
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(number), "lang").filter(spread < F.col("part")).select("number", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            for chunk in text_chunks(batch.column("text")):
                text, gram, n = _grams(chunk)
                np.add.at(total, (numbers[chunk.first + text], gram), n)
        language, gram = np.nonzero(total)
        columns = [pa.array(language, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[language, gram])]
        yield pa.RecordBatch.from_arrays(columns, names=["number", "gram", "n"])

    counted = chosen.mapInArrow(count, "number int, gram int, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    counts = np.full((1 << BITS, len(languages)), SMOOTHING)
    counts[found.gram.to_numpy(), found.number.to_numpy()] += found.n.to_numpy()
    likely = counts / counts.sum(0)
    shares = np.array([held[c] for c in languages], float)
    return Model(languages, shares / shares.sum(), (likely / likely.max(1, keepdims=True)).astype(np.float32))


class _Texts:
    """N-grams of some texts: ``likely`` has a row per n-gram of a text, texts one after the other."""

    def __init__(self, likely: np.ndarray, weight: np.ndarray, sizes: np.ndarray):
        self.likely, self.weight, self.sizes = likely, weight, sizes
        self.first = np.cumsum(sizes) - sizes

    def of(self, chosen: np.ndarray) -> _Texts:
        if chosen.all():
            return self
        kept = np.repeat(chosen, self.sizes)
        return _Texts(self.likely[kept], self.weight[kept], self.sizes[chosen])

    def mixed(self, parts: np.ndarray) -> np.ndarray:
        """The likelihood of each n-gram under the proportions of its text."""
        out = np.zeros(len(self.weight), np.float32)
        for language in range(parts.shape[1]):
            if parts[:, language].any():
                out += self.likely[:, language] * np.repeat(parts[:, language].astype(np.float32), self.sizes)
        return np.maximum(out, np.float32(1e-30))

    def log_likelihood(self, parts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weight * np.log(self.mixed(parts)), self.first, dtype=float)

    def stepped(self, parts: np.ndarray) -> np.ndarray:
        """Proportions after one round of expectation and maximisation; a part of 0 stays 0."""
        share = self.weight / self.mixed(parts)
        new = np.zeros_like(parts)
        for language in range(parts.shape[1]):
            if parts[:, language].any():
                new[:, language] = parts[:, language] * np.add.reduceat(share * self.likely[:, language], self.first, dtype=float)
        return new / new.sum(1, keepdims=True)


def settled(texts: _Texts, parts: np.ndarray) -> np.ndarray:
    """Expectation-maximisation until each text's proportions stand still or ``ROUNDS`` are over."""
    parts = parts.copy()
    moving = np.flatnonzero((parts > 0).sum(1) > 1)
    texts = texts.of(np.isin(np.arange(len(parts)), moving))
    for _ in range(ROUNDS):
        if not len(moving):
            break
        new = texts.stepped(parts[moving])
        still = np.abs(new - parts[moving]).max(1) < SETTLED
        parts[moving] = new
        if still.mean() > 0.2 or still.all():
            moving, texts = moving[~still], texts.of(~still)
    return parts


def language_sets(texts: _Texts, shares: np.ndarray) -> np.ndarray:
    """Proportions of each text over the languages that its penalised likelihood keeps; others are 0."""
    parts = settled(texts, np.repeat(shares[None], len(texts.sizes), 0))
    best = texts.log_likelihood(parts)
    penalty = PENALTY * np.log(np.maximum(np.add.reduceat(texts.weight, texts.first), 2.0))
    languages, done = np.arange(parts.shape[1]), np.zeros(len(parts), bool)
    # Rare languages go together if they may; then one at a time, while the text lets one go.
    going = (parts > 0) & (parts < np.minimum(RARE, parts.max(1))[:, None])
    for _ in languages:
        tried_texts = np.flatnonzero(going.any(1))
        if len(tried_texts):
            some = texts.of(going.any(1))
            tried = np.where(going, 0.0, parts)[tried_texts]
            tried = settled(some, tried / tried.sum(1, keepdims=True))
            reached = some.log_likelihood(tried)
            lost = INDEPENDENT * (best[tried_texts] - reached)
            fits = lost < penalty[tried_texts] * going[tried_texts].sum(1)
            at = tried_texts[fits]
            parts[at], best[at] = tried[fits], reached[fits]
            stay = np.zeros(len(parts), bool)
            # A text that could not let one language go is done; one that kept several may let one go.
            stay[tried_texts[~fits]] = going[tried_texts[~fits]].sum(1) == 1
            done |= stay
        several = ((parts > 0).sum(1) > 1) & ~done
        if not several.any():
            break
        least = np.where(parts > 0, parts, np.inf).argmin(1)
        going = (languages == least[:, None]) & several[:, None]
    return parts


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions) for each row of ``documents``.

    ``languages`` is the text's set, the most frequent first (ties: in code-point order), and
    ``proportions`` their parts; ``lang_pred`` and ``score`` are the first of each. A text that is null
    or has no letter is ``und`` with score 0 and no languages, and so is every text where no language
    was learnt. Repeated rows get equal results; other columns are ignored; an empty table gives none.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array(model.languages, object)
        # A row of ratios per n-gram and language: more languages, smaller chunks.
        size = max(2_000_000 // max(len(names) // 4, 1), 1)
        for batch in batches:
            for chunk in text_chunks(batch.column("text"), size):
                n = len(chunk.ends)
                lettered = batch.column("lettered").slice(chunk.first, n).to_numpy(zero_copy_only=False)
                parts = np.zeros((n, len(names)))
                if len(names):
                    text, gram, count = _grams(chunk)
                    sizes = np.bincount(text, minlength=n)
                    kept = (sizes > 0) & lettered
                    texts = _Texts(model.ratios[gram], count.astype(np.float32), sizes[sizes > 0]).of(lettered[sizes > 0])
                    if kept.any():
                        parts[kept] = language_sets(texts, model.shares)
                yield _predicted(batch.column("doc_id").slice(chunk.first, n), parts, names)

    slim = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    schema = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
    return slim.mapInArrow(run, schema)


def _predicted(ids: pa.Array, parts: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(-parts, axis=1, kind="stable")
    sizes = (parts > 0).sum(1)
    sets = [[str(names[i]) for i in row[:k]] for row, k in zip(order, sizes)]
    shares = [parts[at, row[:k]].tolist() for at, (row, k) in enumerate(zip(order, sizes))]
    columns = [
        ids,
        pa.array([s[0] if s else UNKNOWN for s in sets], pa.string()),
        pa.array([min(s[0], 1.0) if s else 0.0 for s in shares], pa.float64()),
        pa.array(sets, pa.list_(pa.string())),
        pa.array(shares, pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages", "proportions"])
