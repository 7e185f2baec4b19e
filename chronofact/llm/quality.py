"""Quality by hierarchical empirical Bayes: a document classifier's evidence, shrunk host and path posteriors.

Two targets, good quality and toxicity, each get log-odds of a document from a classifier in two steps, fitted on a bounded hash sample of labelled
rows (FIT_ROWS). One half of the sample counts, by grouped aggregation, in how many documents of either label each hashed word
and byte n-gram stands; the smoothed log ratios weigh these features. On the other half a logistic model weighs the mean, the extremes and
the mean of the few extremes of a document's feature weights, and surface figures of the whole text. Only those figures and the feature weights, a fixed number,
come to the driver.

Grouped sums of the probabilities give each host a Beta posterior around the global mean and each
path one around its host's; the strength of either prior comes from the spread between groups, so that
sparse groups shrink to what stands above them. A document's prior is its path's posterior without its own part. It is rejected if
its posterior of good quality is below KEEP_FROM or that of toxicity at least TOXIC_FROM.

Defined results: a null text is empty; a text without words is rejected; a null host or path is a group of its own; rows
repeated are scored alike; a labelled id stands for its text with the least hash; labels without the target, or of one kind, give no evidence
for it and reject nothing but texts without words; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import BitFilter, by_slices, id_of, join_by_key, materialise, text_of, whole_row
from chronofact.shipping import ship

#: Labelled rows that the classifier is fitted on, at most: those whose ids have the least hashes.
FIT_ROWS = 20_000
#: Posteriors below which, and from which, a document is rejected.
KEEP_FROM, TOXIC_FROM = 0.5, 0.5
#: Hash buckets of words, and of n-grams of bytes.
BUCKETS = 1 << 17
NGRAM = 6
#: Extremes that are averaged.
FEW = 5
TARGETS = ("quality", "toxic")
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]=+\\/_", np.uint8)
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def surface(raw: bytes) -> list[float]:
    words, lines = raw.split(), raw.split(b"\n")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = max(1, len(raw)), max(1, len(words))
    upper, lower = h[65:91].sum(), h[97:123].sum()
    return [
        float(np.log1p(len(words))), h[_SYMBOLS].sum() / n, h[48:58].sum() / n, upper / max(1, upper + lower), h[124] / w, (h[33] + h[63]) / w, (h[44] + h[46]) / w,
        min(50.0, n / w), len(set(words)) / w, len(set(lines)) / len(lines), min(20.0, float(np.log1p(n / len(lines)))), (h[9] + h[10] + h[13] + h[32]) / n,
    ]


def buckets(raw: bytes, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text's words, and of its n-grams."""
    low = raw.lower()
    words = np.unique(np.array([zlib.crc32(w) % BUCKETS for w in {w.strip(_MARKS) for w in low.split()}], np.int64))
    b, found = np.frombuffer(low, np.uint8), [np.zeros(0, np.int64)]
    for at in range(0, len(b), block):
        part = b[at : at + block + NGRAM - 1].astype(np.uint64)
        n, code = max(0, len(part) - NGRAM + 1), np.uint64(0)
        for i in range(NGRAM):
            code = code * np.uint64(256) + part[i : i + n]
        found.append(np.unique((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64))
    return words, BUCKETS + np.unique(np.concatenate(found))


def figures(raw: bytes, weights: list[np.ndarray]) -> list[float]:
    """Surface figures, then for each target the mean, extremes and mean few extremes of the weights of words and n-grams."""
    out = surface(raw)
    for some in buckets(raw):
        for own in weights:
            w = own[some] if len(some) else np.zeros(1)
            few = min(FEW, len(w))
            ends = np.partition(w, (few - 1, len(w) - few))
            out += [w.mean(), w.max(), w.min(), ends[-few:].mean(), ends[:few].mean()]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, of a ridge-penalised logistic model on standardised columns; for raw columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    b, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[b[:-1] / scale, b[-1] - (b[:-1] * mean / scale).sum()]


def log_ratios(counts: pd.DataFrame, target: str, totals: tuple[int, int]) -> np.ndarray:
    """Smoothed log ratio of a bucket's share of documents with the label to its share of those without."""
    out = [np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)]
    for label in (0, 1):
        own = counts[(counts["target"] == target) & (counts["label"] == label)]
        out[label][own["bucket"].to_numpy()] = own["n"]
    return np.log((out[1] + 0.5) / (totals[1] + 1)) - np.log((out[0] + 0.5) / (totals[0] + 1))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, columns: dict[str, str], fit_rows: int) -> DataFrame:
    """__t, __half and a label (0, 1 or null) for each target, of the sampled labelled documents."""
    value = lambda t: (F.col(columns[t]).cast("double") > 0.5).cast("int") if t in columns else F.lit(None).cast("int")
    known = labels.select(F.col(label_id).alias("__id"), *[value(t).alias(t) for t in TARGETS]).filter("__id IS NOT NULL").groupBy("__id").agg(*[F.max(t).alias(t) for t in TARGETS])
    sample = materialise(known.filter(" OR ".join(f"{t} IS NOT NULL" for t in TARGETS)).orderBy(F.xxhash64(F.lit(5), "__id"), "__id").limit(fit_rows))
    texts = docs.select(id_of(id_col).alias("__id"), text_of(text_col).alias("__t")).join(F.broadcast(sample.select("__id")), "__id", "left_semi")
    texts = texts.groupBy("__id").agg(F.min(F.struct(F.xxhash64("__t").alias("h"), F.col("__t").alias("t"))).alias("__x"))
    return materialise(texts.join(F.broadcast(sample), "__id").select(F.col("__x.t").alias("__t"), (F.pmod(F.xxhash64(F.lit(6), "__id"), F.lit(2))).alias("__half"), *TARGETS))


def fit(sample: DataFrame) -> tuple[list[np.ndarray], dict[str, np.ndarray | None]]:
    """Feature weights per target, and the logistic weights, None for a target without labels of both kinds."""
    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = {(t, label): np.zeros(2 * BUCKETS, np.int64) for t in TARGETS for label in (0, 1)}
        for part in parts:
            for text, *labels in zip(part["__t"], *[part[t] for t in TARGETS], strict=True):
                own = np.concatenate(buckets(text.encode("utf-8", "surrogatepass")))
                for t, label in zip(TARGETS, labels, strict=True):
                    if label in (0, 1):  # neither null nor not a number
                        n[t, int(label)][own] += 1
        for (t, label), own in n.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame({"target": t, "label": label, "bucket": some, "n": own[some]})

    counts = sample.filter("__half = 0").mapInPandas(counted, "target string, label int, bucket bigint, n bigint")
    counts = counts.groupBy("target", "label", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    totals = sample.filter("__half = 0").agg(*[F.count_if(F.col(t) == label) for t in TARGETS for label in (0, 1)]).first()
    weights = [log_ratios(counts, t, (totals[2 * i], totals[2 * i + 1])) for i, t in enumerate(TARGETS)]
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([np.array(figures(t.encode("utf-8", "surrogatepass"), shared.value)) for t in texts], dtype=object)

    rows = sample.filter("__half = 1").select(measured("__t").alias("__x"), *TARGETS).toArrow().to_pandas()
    models: dict[str, np.ndarray | None] = {}
    for t in TARGETS:
        own = rows[rows[t].notna()]
        y = own[t].to_numpy(float)
        models[t] = fit_logistic(np.stack(own["__x"].to_list()), y) if len(y) and 0 < y.mean() < 1 else None
    return weights, models


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, around: Column) -> float:
    """Prior strength k by moments: groups' means spread as m (1 - m) / (k + 1) plus what n draws of them add."""
    v = F.greatest(around * (1 - around), F.lit(1e-6))
    row = groups.filter("__n > 1").agg(F.avg((mean - around) ** 2 / v).alias("s"), F.avg(1 / F.col("__n")).alias("e")).first()
    between = (row["s"] or 0.0) - (row["e"] or 0.0)
    return float(min(1e4, max(1.0, 1 / between - 1))) if between > 1e-6 else 1e4


def with_evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, label_id: str, columns: dict[str, str], fit_rows: int) -> tuple[DataFrame, list[str]]:
    """doc_id, __id, __th, __host, __path, __empty and each target's log-odds and probability (__p); and the targets that have a model."""
    ship(docs.sparkSession)
    weights, models = fit(sampled(docs, labels, id_col, text_col, label_id, columns, fit_rows))
    shared = docs.sparkSession.sparkContext.broadcast((weights, models))

    def odds(texts: list[str]) -> list:
        weights, models = shared.value
        x = np.array([figures(t.encode("utf-8", "surrogatepass"), weights) for t in texts]).reshape(len(texts), -1)
        none = {"quality": 2.0, "toxic": -2.0}
        return [x[:, 0] == 0, *[np.clip(x @ m[:-1] + m[-1], -30, 30) if (m := models[t]) is not None else np.full(len(x), none[t]) for t in TARGETS]]

    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), F.coalesce(host.cast("string"), F.lit("\0")).alias("__host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("__path"), text_of(text_col).alias("__t"), _site(host, path).alias("__ph"))
    rows = rows.select("doc_id", "__id", "__ph", F.xxhash64("__t").alias("__th"), "__host", F.concat_ws("\1", "__host", "__path").alias("__path"), "__t")
    rows = by_slices(rows, "__t", ", ".join(["__empty boolean", *[f"{t}_log_odds double" for t in TARGETS]]), odds)
    return materialise(rows.withColumns({f"__p_{t}": 1 / (1 + F.exp(-F.col(f"{t}_log_odds"))) for t in TARGETS})), [t for t in TARGETS if models[t] is not None]


def with_posteriors(rows: DataFrame, targets: tuple[str, ...] | list[str] = TARGETS) -> DataFrame:
    """rows (of `with_evidence`) with host_, path_ posterior and the document's posterior of each target."""
    paths = materialise(rows.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__p_{t}").alias(f"__sum_{t}") for t in targets]))
    hosts = materialise(paths.groupBy("__host").agg(F.sum("__n").alias("__n"), *[F.sum(f"__sum_{t}").alias(f"__sum_{t}") for t in targets], F.count(F.lit(1)).alias("__paths")))
    overall = hosts.agg(F.sum("__n").alias("n"), F.sum("__paths").alias("paths"), *[F.sum(f"__sum_{t}").alias(t) for t in targets]).first()
    total, means = int(overall["n"] or 0), {t: float(overall[t] / overall["n"]) if overall["n"] else 0.5 for t in targets}
    own = lambda t: F.col(f"__sum_{t}") / F.col("__n")
    k = {t: _strength(hosts, own(t), F.lit(means[t])) for t in targets}
    hosts = materialise(hosts.select("__host", "__paths", *[((F.lit(k[t] * means[t]) + F.col(f"__sum_{t}")) / (F.lit(k[t]) + F.col("__n"))).alias(f"host_{t}") for t in targets]))
    paths = materialise(join_by_key(paths, hosts, ["__host"], "__paths", int(overall["paths"] or 0), F.xxhash64("__path")).drop("__paths", "__host"))
    k2 = {t: _strength(paths, own(t), F.col(f"host_{t}")) for t in targets}
    out = join_by_key(rows, paths, ["__path"], "__n", total, F.struct("__id", "__th"))
    for t in targets:
        without = (F.lit(k2[t]) * F.col(f"host_{t}") + F.col(f"__sum_{t}") - F.col(f"__p_{t}")) / (F.lit(k2[t]) + F.col("__n") - 1)
        out = out.withColumn(f"path_{t}", without)
        out = out.withColumn(t, 1 / (1 + F.exp(-(F.col(f"{t}_log_odds") + _logit(F.col(f"path_{t}")) - _logit(F.lit(means[t]))))))
    return out


def score(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", toxic_col: str = "toxic",
    keep_from: float = KEEP_FROM, toxic_from: float = TOXIC_FROM, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Per document: doc_id, __id, __th, __ph, and for quality and toxicity log-odds, host and path posterior and the posterior itself; kept."""
    columns = {t: c for t, c in (("quality", label_col), ("toxic", toxic_col)) if c in labels.columns}
    rows, modelled = with_evidence(docs, labels, host, path, id_col, text_col, label_id, columns, fit_rows)
    out = with_posteriors(rows).withColumn("quality", F.when(F.col("__empty"), F.lit(0.0)).otherwise(F.col("quality")))
    kept = ~F.col("__empty")
    if "quality" in modelled:
        kept = kept & (F.col("quality") >= keep_from)
    if "toxic" in modelled:
        kept = kept & (F.col("toxic") < toxic_from)
    return out.select("doc_id", "__id", "__th", "__ph", *[c for t in TARGETS for c in (f"{t}_log_odds", f"host_{t}", f"path_{t}", t)], kept.alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents that stay, with all columns of `docs`. A filter of the rejected tells the rows that move to be held against them; the others stay where they are. Rows
    repeated in id and text, but under another host or path, are judged each by their own.
    """
    key = F.xxhash64("__id", "__th", "__ph")
    gone = materialise(score(docs, labels, host, path, id_col, text_col, **options).filter("not kept").select("__id", "__th", "__ph").distinct())
    own = _site(host, path).alias("__ph")
    rows = docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), own)
    rows = BitFilter.of(gone, key, gone.count()).mark(rows, key, "__maybe")
    held = rows.filter("__maybe").join(gone, ["__id", "__th", "__ph"], "left_anti")
    return rows.filter("not __maybe").select("__row.*").unionByName(held.select("__row.*"))


def _site(host: Column, path: Column) -> Column:
    """A hash of host and path, of null ones too."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in (host, path)])
