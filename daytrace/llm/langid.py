"""Language ID: nearest of several centroids per language, by cosine of hashed TF-IDF letter n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.session import ship

#: Length of a vector; n-grams of 1 to 3 letters are hashed into it.
SLOTS = 4096
#: Distinct texts per language (in expectation; all where there are fewer) that its centroids are fitted on; document frequencies cover all rows.
FIT_TEXTS = 1500
CENTROIDS = 4
#: A text further from its centroid than all but this share of the fitted texts is marked rejected.
REJECT = 0.002
UNKNOWN = "und"
_CHUNK = 256


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's letter n-grams by slot; runs of anything else are one space. None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of spaces
    c = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0xD6E8FEB86659FD93)
    hashed = np.concatenate((c[1:-1] * np.uint64(0xFF51AFD7ED558CCD), two, three))
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((hashed >> np.uint64(52)).astype(np.int64), minlength=SLOTS)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors (a row per text, zero without letters) and which texts have letters."""
    out = np.zeros((len(texts), SLOTS), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        counts = ngram_counts(text)
        if counts is not None:
            has[i] = True
            v = np.log1p(counts) * idf
            norm = np.sqrt(v @ v)
            out[i] = v / norm if norm else 0
    return out, has


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids: farthest-first start from the vector nearest to the mean, then Lloyd rounds by cosine."""
    mean = x.mean(axis=0)
    picked = [int((x @ mean).argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centroids = x[picked].copy()
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        for j in range(len(centroids)):
            members = x[own == j]
            if len(members):
                total = members.sum(axis=0)
                centroids[j] = total / max(np.sqrt(total @ total), 1e-12)
    return centroids


def _document_frequencies(train: DataFrame) -> np.ndarray:
    """Inverse document frequency of every slot over all of ``train``: SLOTS + 1 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            for text in batch._text:
                counts = ngram_counts(text)
                if counts is not None:
                    seen += counts > 0
                    n += 1
        yield pd.DataFrame({"slot": np.arange(SLOTS + 1), "n": np.append(seen, n)})

    rows = train.select("_text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SLOTS + 1)
    for r in rows:
        df[r.slot] = r.n
    return (np.log((1 + df[SLOTS]) / (1 + df[:SLOTS])) + 1).astype(np.float32)


def fit(train: DataFrame, fit_texts: int = FIT_TEXTS, centroids: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """idf, and per centroid its language, vector and rejection cosine; ``train`` has _text and _lang (not null).

    Document frequencies come from all rows. Centroids are fitted per language on distinct texts whose hash falls
    under fit_texts / (distinct texts of the language), or on all of them where they are fewer; one task per language; a
    few centroids per language reach the driver.
    """
    idf = _document_frequencies(train)
    n = train.select("_lang", F.xxhash64("_text").alias("_key")).distinct().groupBy("_lang").agg(F.count("*").alias("_n"))
    unit = F.shiftrightunsigned(F.xxhash64("_text"), 11) / float(1 << 53)
    some = train.join(F.broadcast(n), "_lang").where(unit * F.col("_n") < fit_texts).groupBy("_lang", F.xxhash64("_text")).agg(F.first("_text").alias("_text"))

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, has = vectors(pdf._text.tolist(), idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "cosine": []})
        found = spherical_kmeans(x, centroids)
        like = x @ found.T
        own, best = like.argmax(axis=1), like.max(axis=1)
        limits = [float(np.quantile(best[own == j], REJECT)) if (own == j).any() else 0.0 for j in range(len(found))]
        return pd.DataFrame({"lang": key[0], "centroid": list(found), "cosine": limits})

    rows = some.select("_lang", "_text").groupBy("_lang").applyInPandas(cluster, "lang string, centroid array<float>, cosine double").collect()
    rows.sort(key=lambda r: (r.lang, tuple(r.centroid[:8])))
    return idf, [r.lang for r in rows], np.array([r.centroid for r in rows], dtype=np.float32).reshape(-1, SLOTS), np.array([r.cosine for r in rows])


def predict(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score (cosine to the nearest centroid, 0..1) and rejected (too far from it)."""
    idf, langs, centroids, limits = model
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string, score double, rejected boolean"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                part = batch.iloc[at : at + _CHUNK]
                x, has = vectors(part[text].tolist(), idf)
                out = part[keep].copy()
                if len(langs):
                    like = x @ centroids.T
                    own = like.argmax(axis=1)
                    score = np.clip(like[np.arange(len(part)), own].astype(float), 0, 1)
                    out["lang_pred"] = np.where(has, np.array(langs, dtype=object)[own], UNKNOWN)
                    out["score"], out["rejected"] = np.where(has, score, 0.0), ~has | (score < limits[own])
                else:
                    out["lang_pred"], out["score"], out["rejected"] = UNKNOWN, 0.0, True
                yield out

    return docs.mapInPandas(judge, schema)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, rejected.

    Held out are rows with crc32(id as text) mod 5 = 0, and those without an id; the others with a language are learned
    from. Null texts and texts without a letter are ``und`` with score 0, and so is all if there is nothing to learn
    from. Of equally near centroids the first by language wins. Equal texts get equal results; an empty table gives no
    rows. Only id, text and language are read.
    """
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(docs[doc_id].cast("string")) % 5 == 0, F.lit(True))
    rows = docs.select(docs[doc_id].alias(doc_id), held.alias("held_out"), docs[text].alias("_text"), docs[lang].alias("_lang"))
    model = fit(rows.where(~F.col("held_out") & F.col("_lang").isNotNull()).select("_text", "_lang"))
    return predict(rows.drop("_lang"), model, [doc_id, "held_out"], "_text")
