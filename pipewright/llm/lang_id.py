"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a log-probability matrix (hash bucket x language), fitted on a bounded sample of labelled rows,
broadcast, and applied to whole texts by sparse batch scoring in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import map_arrow, slices

_SLICE = 1 << 18
SCORED = "language string, language_score double, language_fit double, n_grams long"


@dataclass(frozen=True)
class LanguageModel:
    """``matrix``: log P(bucket | language), float32 ``[2**bits, languages]``.  ``fit_low``: per language, the mean
    log-probability per n-gram below which a long text is unlike anything the language was fitted on."""

    languages: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray
    fit_mean: np.ndarray
    fit_spread: np.ndarray
    bits: int
    orders: tuple[int, ...]


def _grams(texts: list[str], bits: int, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram of letters, and the row it is in."""
    # Each row opens with a separator, so that its n-grams do not depend on the rows around it.
    joined = ("\n" + "\n".join(texts)).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.cumsum(codes == 10) - 1
    # A text's own line breaks are spaces; they were replaced before joining, so "\n" only separates rows.
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00)) & ~((codes >= 0x3000) & (codes < 0x3040))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary sign after each run of letters
    keep[:-1] |= letter[1:]  # and before it
    keep |= codes == 10
    codes, rows, letter = codes[keep].astype(np.uint64), rows[keep], letter[keep]
    codes = np.where(letter, codes, np.uint64(32))
    found = []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        key, some = codes[:m].copy(), letter[:m].copy()
        for k in range(1, n):
            key = key * np.uint64(1_114_123) + codes[k : m + k]
            some |= letter[k : m + k]
        ok = some & (rows[:m] == rows[n - 1 :])
        bucket = ((key[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        found.append((bucket, rows[:m][ok]))
    return found


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive parts of about ``_SLICE`` characters: their n-gram arrays are some 60 times as large."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _clean(texts: list[str | None]) -> list[str]:
    return [(t or "").replace("\n", " ") for t in texts]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = 1000, sample_bytes: int = 6 << 20, bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.05, seed: int = 7) -> LanguageModel:
    """Fits on whole texts of a bounded sample: per language the rows with the smallest salted text hashes, at most
    ``sample_rows`` of them and at most ``sample_bytes`` bytes (one row at least).

    Rows whose text or label is null or empty are not used; equal texts of a label count once.  Without a labelled row
    the model has no languages and every document is ``und``.  Two passes over the table: one estimates the number of
    different texts of each label, by which the other leaves a small multiple of the sample to be sorted.
    """
    rows = labelled.where((F.octet_length(F.col(f"`{text}`")) > 0) & F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"))
    # One row for each language.
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t", F.lit(seed))).alias("n")).collect()}
    if not counts:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros(0), bits, tuple(orders))
    # A hash threshold for each label first, then the exact smallest: the sort sees a small multiple of the sample.
    whole = 1 << 60
    most = F.lit(whole)
    for lang, n in counts.items():
        # Twice the sample is expected below the limit; the estimate of n is within a tenth or so.
        most = F.when(F.col("l") == lang, F.lit(min(whole, whole * 2 * sample_rows // max(n, 1)))).otherwise(most)
    few = rows.withColumn("k", F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(whole))).where(F.col("k") < most).dropDuplicates(["l", "k"])
    order = Window.partitionBy("l").orderBy("k", "t")
    size = F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(order)
    taken = few.withColumn("rank", rank).withColumn("size", size).where((F.col("rank") <= sample_rows) & ((F.col("size") <= sample_bytes) | (F.col("rank") == 1)))
    found = taken.select("l", "t", "k").toPandas().sort_values(["l", "k", "t"])
    return fit_local(found["t"].tolist(), found["l"].tolist(), bits, tuple(orders), smoothing)


def fit_local(texts: list[str], labels: list[str], bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.05) -> LanguageModel:
    """The fit itself, on lists.  A third of the rows calibrates the fit scores."""
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(labels)) % 3 == 2
    counts = np.full((1 << bits, len(languages)), smoothing)
    texts = _clean(texts)
    for k in range(len(languages)):
        own = [t for t, a, h in zip(texts, y, held, strict=True) if a == k and not h] or [t for t, a in zip(texts, y, strict=True) if a == k]
        for part in _chunks(own):
            for bucket, _ in _grams(part, bits, orders):
                counts[:, k] += np.bincount(bucket, minlength=1 << bits)
    matrix = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    prior = np.log(np.bincount(y, minlength=len(languages)) / len(y))
    blank = LanguageModel(languages, matrix, prior, np.zeros(len(languages)), np.ones(len(languages)), bits, orders)
    scored = [score_texts(blank, part) for part in _chunks([t for t, h in zip(texts, held, strict=True) if h] or texts)]
    total, n = np.concatenate([t for t, _ in scored]), np.concatenate([c for _, c in scored])
    ys = y[held] if held.any() else y
    mean, spread = np.zeros(len(languages)), np.ones(len(languages))
    for k in range(len(languages)):
        own = (ys == k) & (n >= 100)
        if own.any():
            per = total[own, k] / n[own]
            mean[k], spread[k] = np.median(per), max(0.1, 1.4826 * np.median(np.abs(per - np.median(per))))
        else:
            mean[k], spread[k] = -np.inf, 1.0
    return LanguageModel(languages, matrix, prior, mean, spread, bits, orders)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities ``[texts, languages]`` and the number of n-grams of each text."""
    total = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts), dtype=np.int64)
    for bucket, row in _grams(_clean(texts), model.bits, model.orders):
        if not len(bucket):
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        n[row[first]] += np.diff(np.r_[first, len(row)])
        for k in range(len(model.languages)):
            total[row[first], k] += np.add.reduceat(model.matrix[:, k][bucket], first, dtype=np.float64)
    return total, n


def decide(model: LanguageModel, total: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Language, posterior and fit of scored texts; ``und`` without any letter."""
    if not len(model.languages):
        return pd.DataFrame({"language": ["und"] * len(n), "language_score": 0.0, "language_fit": 0.0, "n_grams": n})
    logits = total + model.prior
    best = logits.argmax(axis=1)
    top = logits[np.arange(len(n)), best]
    posterior = 1.0 / np.exp(np.clip(logits - top[:, None], -700, 0)).sum(axis=1)
    per = total[np.arange(len(n)), best] / np.maximum(n, 1)
    fit_score = (per - model.fit_mean[best]) / model.fit_spread[best]
    known = n > 0
    return pd.DataFrame(
        {
            "language": np.where(known, np.array(model.languages, dtype=object)[best], "und"),
            "language_score": np.where(known, np.round(posterior, 6), 0.0),
            "language_fit": np.where(known & np.isfinite(fit_score), np.round(fit_score, 6), 0.0),
            "n_grams": n,
        }
    )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``language``, ``language_score`` (posterior), ``language_fit`` (robust z-score of the
    log-probability per n-gram) and ``n_grams``, for every row, from its whole text.

    A null, empty or letterless text gets ``und``, score 0.  Repeated rows get equal results.  Kept columns with the
    name of a result column are replaced by it.
    """
    keep = tuple(c for c in keep if c not in ("language", "language_score", "language_fit", "n_grams"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), SCORED])

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "__text", _SLICE):
            total, n = score_texts(shared.value, part.column("__text").to_pylist())
            out = decide(shared.value, total, n)
            columns = [part.column(c) for c in keep] + [pa.array(out[c]) for c in ("language", "language_score", "language_fit", "n_grams")]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "language", "language_score", "language_fit", "n_grams"])

    return map_arrow(picked, run, schema)


def filter_languages(docs: DataFrame, model: LanguageModel, text: str = "text", languages: tuple[str, ...] | None = None, min_score: float = 0.5, min_fit: float = -25.0, short: int = 300) -> DataFrame:
    """Rows of ``docs``, columns unchanged, that have an identified language.

    Rejected are texts without letters (null and empty ones among them), texts whose best posterior is below
    ``min_score``, texts of another language than ``languages`` (None: any the model knows), and texts whose fit is
    below ``min_fit`` robust deviations, i.e. that are no text of any fitted language.  The mean of few n-grams spreads
    more: of n of them, the limit is that of a long text times sqrt(1 + ``short`` / n).  One map over the rows: no
    shuffle.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<language:string,language_score:double,language_fit:double,n_grams:long>")
    def scored(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], names=["t"])
        parts = [decide(shared.value, *score_texts(shared.value, part.column("t").to_pylist())) for part in slices(whole, "t", _SLICE)]
        found = pd.concat(parts, ignore_index=True) if parts else decide(shared.value, *score_texts(shared.value, []))
        kinds = {"language": pa.string(), "language_score": pa.float64(), "language_fit": pa.float64(), "n_grams": pa.int64()}
        return pa.StructArray.from_arrays([pa.array(found[c], kind) for c, kind in kinds.items()], names=list(kinds))

    mark = "__language"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    made = docs.withColumn(mark, scored(F.col(f"`{text}`")))
    row = made.select("*", *[F.col(f"{mark}.{c}").alias(f"{mark}_{c}") for c in ("language", "language_score", "language_fit", "n_grams")])
    m = {c: F.col(f"{mark}_{c}") for c in ("language", "language_score", "language_fit", "n_grams")}
    condition = (m["language"] != "und") & (m["language_score"] >= min_score) & (m["language_fit"] >= F.lit(min_fit) * F.sqrt(1 + F.lit(float(short)) / m["n_grams"]))
    if languages:
        condition &= m["language"].isin(*languages)
    return row.where(condition).select(*[F.col(f"`{c}`") for c in docs.columns])
