"""Reading level of documents, by a Rasch-style model of documents and words.

A document has a level and a word a difficulty on one scale. Each occurrence of a word in a document is a contest that ends in a draw, so the likelihood of all occurrences is the sum of
log p + log (1 - p), p being the logistic function of level minus difficulty; it is largest where each document meets its words and each word its documents. Words used at all levels tell little, so a word's
occurrences count with its discrimination: the inverse of the spread of the labelled levels around it, drawn towards that of all labels where labels are few. Documents with human labels are held at
these, and the others count for less. The sum is concave in levels and difficulties together, and both are moved in turn by Newton's steps on that one sum until the levels stay. Words of all documents
take part. Four cut points between the levels are fitted on the labelled documents at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milap.session import stage

_WORD = re.compile(r"[^\W\d_]+")


def occurrences(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, word, n, first)``: how often each document uses each word, as 64-bit hashes; ``first`` marks one row of a document.

    Words are runs of letters of any script, lower-cased; whole texts are read; null and empty texts give no rows.
    """
    known: dict[str, int] = {}

    def number(w: str) -> int:
        if w not in known:
            if len(known) > 500_000:
                known.clear()
            known[w] = xxhash.xxh64_intdigest(w.encode()) - (1 << 63)
        return known[w]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, ns, totals = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Counter(_WORD.findall(t.lower())) if t else {}
                ids += [d] * len(c)
                words += map(number, c)
                ns += c.values()
                totals += [sum(c.values())] * len(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(ns, pa.int32()), pa.array(totals, pa.int32())], ["doc_id", "word", "n", "doc_words"])

    return docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), text_col).mapInArrow(count, "doc_id long, word long, n int, doc_words int")


def _pull(at: Column, b: Column, weight: Column, steep: float) -> tuple[Column, Column]:
    """Gradient and curvature of an occurrence's term of the likelihood in the level ``at``; in the difficulty the gradient is the opposite."""
    p = 1 / (1 + F.exp(-steep * (at - b)))
    return weight * steep * (1 - 2 * p), weight * 2 * steep * steep * p * (1 - p)


def with_words(occ: DataFrame, words: DataFrame, docs: int, share: float = 0.001) -> DataFrame:
    """Occurrences with their word's columns. Words of more than ``share`` of all documents, of which there are at most a document's mean number of different words divided by ``share``, are broadcast, so no task holds all occurrences of a frequent word."""
    hot = F.col("docs") > max(1000.0, share * docs)
    frequent = F.broadcast(words.where(hot).drop("docs"))
    return occ.join(frequent, "word").unionByName(occ.join(frequent.select("word"), "word", "left_anti").join(words.where(~hot).drop("docs"), "word"))


def fit_levels(occ: DataFrame, labels: DataFrame, *, steep: float = 2.0, unlabelled: float = 0.1, prior: float = 4.0, min_docs: int = 5, ridge: float = 0.5, close: float = 0.01, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """``(levels, words)``: ``(doc_id, theta, doc_words, known)`` of every document with words, and ``(word, b, a, docs, taught)``.

    ``labels`` is ``(doc_id, label)``, one row for each labelled document. ``known`` counts the document's occurrences of words that also occur in at least ``min_docs``
    labelled documents: these are words of the labelled language. ``steep`` is the slope of the logistic function, ``unlabelled`` the weight of a document without label, ``prior`` the number of labels that a word's spread is
    drawn to that of all labels with, and ``ridge`` a word's pull to where it started. Ends when levels change by less than ``close`` on average; ``RuntimeError`` if ``max_rounds`` don't suffice.
    """
    all_of = labels.agg(F.var_pop("label").alias("v"), F.avg("label").alias("m")).first()
    spread, mean = max(float(all_of["v"] or 0.0), 0.02), float(all_of["m"] or 0.0)
    # a word starts at the mean label of the documents that use it; one without labels waits for the first levels
    said = occ.join(labels, "doc_id", "left").groupBy("word").agg(F.count("*").alias("docs"), F.count("label").alias("taught"), F.avg("label").alias("b0"), F.coalesce(F.var_pop("label"), F.lit(0.0)).alias("v"))
    words = stage(said.select("word", "docs", "taught", F.coalesce("b0", F.lit(mean)).alias("b"), (1 / F.greatest(F.lit(0.02), (F.col("taught") * F.col("v") + prior * spread) / (F.col("taught") + prior))).alias("a")), "words")
    docs = occ.select("doc_id").distinct().count()
    start = with_words(occ, words.select("word", "b", "a", "taught", "docs"), docs).groupBy("doc_id").agg(F.sum(F.when(F.col("taught") > 0, F.col("n") * F.col("a") * F.col("b"))).alias("s"), F.sum(F.when(F.col("taught") > 0, F.col("n") * F.col("a"))).alias("w"), F.max("doc_words").alias("doc_words"), F.sum(F.when(F.col("taught") >= min_docs, F.col("n")).otherwise(0)).alias("known"))
    theta = stage(start.join(labels, "doc_id", "left").select("doc_id", "label", "doc_words", "known", F.coalesce(F.col("s") / F.col("w"), F.lit(mean)).alias("theta")), "theta")
    for _ in range(max_rounds):
        # difficulties, labelled documents held at their labels
        held = theta.select("doc_id", F.coalesce("label", "theta").alias("at"), F.when(F.col("label").isNull(), unlabelled).otherwise(1.0).alias("share"))
        g, c = _pull(F.col("at"), F.col("b"), F.col("n") * F.col("share"), steep)
        move = with_words(occ.select("doc_id", "word", "n"), words.select("word", "b", "docs"), docs).join(held, "doc_id").groupBy("word").agg((-F.sum(g)).alias("g"), F.sum(c).alias("c"))
        words = stage(words.join(move, "word").select("word", "docs", "taught", (F.col("b") + F.greatest(F.lit(-0.7), F.least(F.lit(0.7), F.col("g") / (F.col("c") + ridge)))).alias("b"), "a"), "words")
        # levels; a labelled document's is found like the others', but not used for the words
        here = with_words(occ.select("doc_id", "word", "n"), words.select("word", "b", "a", "docs"), docs).join(theta.select("doc_id", "theta"), "doc_id")
        g, c = _pull(F.col("theta"), F.col("b"), F.col("n") * F.col("a"), steep)
        step = here.groupBy("doc_id").agg(F.greatest(F.lit(-0.7), F.least(F.lit(0.7), F.sum(g) / (F.sum(c) + 1e-9))).alias("step"))
        moved = stage(theta.join(step, "doc_id").select("doc_id", "label", "doc_words", "known", (F.col("theta") + F.col("step")).alias("theta"), "step"), "theta")
        theta = moved.drop("step")
        if (moved.agg(F.avg(F.abs("step")).alias("d")).first()["d"] or 0.0) < close:
            return theta.drop("label"), words
    raise RuntimeError(f"levels are not stable after {max_rounds} rounds")


def cut_points(theta: np.ndarray, label: np.ndarray, levels: int = 5) -> np.ndarray:
    """Cuts between neighbouring levels that put the fewest labelled documents on the wrong side; ties go to the middle."""
    cuts = []
    for k in range(1, levels):
        order = np.argsort(theta)
        t, above = theta[order], label[order] > k
        wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum(~above[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[len(best) // 2])
        edge = np.concatenate([[t[0] - 1 if len(t) else k + 0.5], t, [t[-1] + 1 if len(t) else k + 0.5]])
        cuts.append((edge[i] + edge[i + 1]) / 2)
    return np.maximum.accumulate(np.array(cuts))


def reading_levels(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", label_doc: str = "doc_id", label_col: str = "level", min_known: int = 20, min_share: float = 0.5, sample: int = 100_000) -> DataFrame:
    """``(doc_id, level, theta)`` of every document that is mainly running prose in the language of the labelled ones.

    That is: at least ``min_known`` words and the share ``min_share`` of all its words occur in the labelled documents' vocabulary. Raters of one document are averaged;
    null labels are dropped. The cut points are fitted on at most ``sample`` labelled documents, those with the smallest hash. Null and empty
    texts get no level. Without labels nothing can be fitted and no document gets a level.
    """
    rated = stage(labels.where(F.col(label_col).isNotNull() & F.col(label_doc).isNotNull()).groupBy(F.col(label_doc).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("label")), "rated")
    occ = stage(occurrences(docs, doc_col, text_col), "occurrences")
    if not rated.limit(1).count():
        return occ.select("doc_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("theta")).limit(0)
    theta, _ = fit_levels(occ, rated)
    prose = theta.where((F.col("known") >= min_known) & (F.col("known") >= min_share * F.col("doc_words")))
    fit = prose.join(rated, "doc_id").orderBy(F.xxhash64("doc_id")).limit(sample).select("theta", "label").toPandas()
    cuts = cut_points(fit.theta.to_numpy(float), np.floor(fit.label.to_numpy(float) + 0.5))
    level = sum((F.when(F.col("theta") > float(c), 1).otherwise(0) for c in cuts), F.lit(1))
    return prose.select("doc_id", level.cast("int").alias("level"), "theta") if len(fit) else prose.select("doc_id", F.lit(None).cast("int").alias("level"), "theta").limit(0)
