"""Mixing sources to target weights, by hierarchical budgeting.

The tree of a mix has domains under its root, languages under these, and the sources of a language in a domain as leaves: a source has one leaf for each domain and language its documents
are of, with the tokens of these, and its share is spread over its leaves by their tokens. A budget of tokens is handed down by weight; what a leaf cannot take, as its tokens times its repeats are fewer, is
handed to its siblings by their weights, then to the leaves of the parent's siblings, up to the root. Each leaf then fills its budget with whole epochs over its documents and a prefix of one more epoch,
in an order drawn by seed, so the same documents are drawn whatever the partitioning.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A folder of public vocabularies; see the installed tokenizers' description.
TOKENIZERS = "/opt/tokenizers"
_BUCKETS = 4096
_LOADED: dict = {}


def _encoder(path: str):
    import tiktoken

    if path not in _LOADED:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(docs: DataFrame, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The table with ``text`` replaced by ``n_tokens``; 0 for null and empty texts. Whole texts are tokenized."""
    keep = [c for c in docs.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(x)) if x else 0 for x in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, "n_tokens"])

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.mapInArrow(count, schema)


def leaf_budgets(targets: pd.DataFrame, supply: pd.DataFrame, total: float) -> pd.DataFrame:
    """Budgets of the leaves of one mix. ``targets``: source, target_share, max_repeats; ``supply``: source, domain, language, tokens, one row for each leaf.

    Adds ``capacity`` (tokens times repeats), ``wanted`` (the leaf's part of its source's share of ``total``) and ``budget`` <= capacity. Shortages go to siblings
    in the same language and domain by weight, then to those in the domain, then to all. Null shares and repeats count as 0. A source without documents has one empty leaf.
    """
    t = targets.merge(supply, on="source", how="left").fillna({"target_share": 0.0, "max_repeats": 0, "tokens": 0.0, "domain": "", "language": ""})
    held = t.groupby("source").tokens.transform("sum")
    part = (t.tokens / held).where(held > 0, 1.0 / t.groupby("source").tokens.transform("size"))
    t["weight"] = t.target_share * part
    t["capacity"] = t.tokens.astype(float) * t.max_repeats
    t["wanted"] = t.weight * total
    t["budget"] = t[["capacity", "wanted"]].min(axis=1)
    for level in (["domain", "language"], ["domain"], []):
        for rows in (t.groupby(level).groups.values() if level else [t.index]):
            for _ in range(len(rows) + 1):
                # what this node was to hold, and what its leaves hold already
                missing = t.loc[rows, "wanted"].sum() - t.loc[rows, "budget"].sum()
                room = (t.loc[rows, "capacity"] - t.loc[rows, "budget"]).clip(lower=0)
                weight = t.loc[rows, "weight"].where(room > 1e-9, 0.0)
                if missing <= 1e-6 or weight.sum() <= 0:
                    break
                t.loc[rows, "budget"] += (missing * weight / weight.sum()).clip(upper=room)
    return t


def mix_plan(counted: DataFrame, targets: DataFrame, max_leaves: int = 100_000) -> DataFrame:
    """``leaf_budgets`` of every mix as a table, one row for each (mix_id, source, domain, language).

    ``counted``: documents with ``n_tokens``; ``targets``: mix_id, source, target_share, max_repeats. The total is the tokens of all documents with a source. Targets with a null key are dropped, of
    repeated keys the largest share and repeats count. Mixes are planned on the driver, so more than ``max_leaves`` targets, leaves of documents or leaves of all mixes are a ``ValueError``.
    """
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t, supply = (x.limit(max_leaves + 1).toPandas() for x in (wanted, leaf_supply(counted)))
    total = float(supply.tokens.sum())
    rows = [] if max(len(t), len(supply)) > max_leaves else [leaf_budgets(g.drop(columns="mix_id"), supply, total).assign(mix_id=m) for m, g in t.groupby("mix_id")]
    if max(len(t), len(supply), sum(map(len, rows))) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    schema = "mix_id int, source string, domain string, language string, target_share double, max_repeats int, tokens double, capacity double, wanted double, budget double"
    names = [c.split()[0] for c in schema.split(", ")]
    flat = [(int(r[0]), r[1], r[2], r[3], float(r[4]), int(r[5]), *map(float, r[6:])) for d in rows for r in d[names].itertuples(index=False)]
    return counted.sparkSession.createDataFrame(flat, schema)


def of_sources(plan: DataFrame) -> DataFrame:
    """The plan's leaves added up by source; ``short`` says that the source's own tokens don't fill the budget it wanted."""
    out = plan.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), *(F.sum(c).alias(c) for c in ("tokens", "capacity", "wanted", "budget")))
    # budgets are only ever cut at a leaf's capacity, and handed on from there
    return out.withColumn("short", F.col("wanted") - F.col("budget") > 1e-9 * F.col("wanted"))


def leaf_supply(counted: DataFrame) -> DataFrame:
    """``(source, domain, language, tokens)``: the leaves that have documents.

    ``domain`` is the page type, ``language`` the language column; null and '' are one. Null sources belong to no mix.
    """
    return counted.where("source is not null").groupBy("source", _domain().alias("domain"), _language().alias("language")).agg(F.sum("n_tokens").alias("tokens"))


def _domain():
    return F.coalesce("page_type", F.lit(""))


def _language():
    return F.coalesce("lang", F.lit(""))


def draw(counted: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """``(mix_id, source, doc_id, copies)``: how often each mix takes each document, by a plan of leaves. ``counted`` has doc_id, source, page_type, lang and n_tokens.

    Documents come in the order of a hash of seed, mix, epoch and id; ties by id. A leaf takes whole epochs, then documents of the
    next epoch while the tokens before them are fewer than what is left of its budget. The order's running sum is taken over buckets of the hash
    first and then only inside the bucket where the budget ends, so no source is ever sorted in one task.
    """
    docs = counted.where("source is not null").select("doc_id", "source", _domain().alias("domain"), _language().alias("language"), "n_tokens")
    leaf = ["source", "domain", "language"]
    leaves = plan.where("budget > 0 and tokens > 0").select("mix_id", *leaf, F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats")).cast("int").alias("epochs"), "budget", "tokens", "max_repeats").withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    each = docs.join(F.broadcast(leaves), leaf).withColumn("h", F.xxhash64(F.lit(seed), "mix_id", "epochs", "doc_id")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int"))
    from pyspark.sql import Window

    sums = each.groupBy("mix_id", *leaf, "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("mix_id", *leaf).orderBy("bucket")) - F.col("n")).drop("n")
    placed = each.join(before, ["mix_id", *leaf, "bucket"])
    inside = placed.where("before < rest").withColumn("start", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("mix_id", *leaf, "bucket").orderBy("h", "doc_id")) - F.col("n_tokens"))
    extra = inside.where("start < rest and epochs < max_repeats").select("mix_id", "source", "doc_id", F.lit(1).alias("copies"))
    whole = each.where("epochs > 0").select("mix_id", "source", "doc_id", F.col("epochs").alias("copies"))
    return whole.unionByName(extra).groupBy("mix_id", "source", "doc_id").agg(F.sum("copies").cast("int").alias("copies"))
