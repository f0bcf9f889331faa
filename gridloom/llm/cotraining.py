"""Quality classifier by co-training.

Two views of a document, each with its own logistic regression: hashed words with a few statistics of
the text, and its metadata (language, source, length). From the labelled sample both are fitted, and their scores
calibrated on held-out labels (Platt). In each round each view ranks all unlabelled documents by its calibrated score and
gives its surest of either class, in the class ratio of the labels, to the other view to learn from; a document that the
other view is nearly certain is of the other class (`VETO`) is passed over. A last
regression of the two calibrated logits, on labels held out from both, gives the score of every document.

The labelled sample is bounded: at most `labelled` documents, of least hash of the id. Pseudo-labels are
sought in all documents, whatever their number; `per_round` is how many a view gives in a round, as in
the published method, or a tenth of the labelled sample if that is less, so that it isn't drowned. Only those few are fetched with their vectors. Scoring covers all documents and
whole texts.

Null texts have no words; null languages and sources are values of their own; documents with a null id
are scored but give no pseudo-label. Labels that are null or have no document are ignored, of several for
one id the least counts. Without labels of both classes every document gets the share of good labels (1
without labels) as its score. Repeated rows score alike; extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shingles import U, text_bytes, word_hashes
from gridloom.session import staged

LABELLED, ROUNDS, VETO, PER_ROUND, PARTS = 4000, 4, 2.2, 300, 64
WORDS, META, STATS = 512, 64, 6
_byte = np.arange(256)
CLASSES = np.select([(_byte >= 65) & (_byte <= 90), (_byte >= 48) & (_byte <= 57), np.isin(_byte, [ord(c) for c in "#*$%&|<>!"]), (_byte == 32) | (_byte == 10)], [0, 1, 2, 3], 4)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of a batch, one row a document."""
    data, at = text_bytes(batch.column("text"))
    words, word_at = word_hashes(data, at)
    n = len(batch)
    owner = np.repeat(np.arange(n), np.diff(word_at))
    counts = np.bincount(owner * WORDS + (words % U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    text = np.zeros((n, WORDS + STATS), np.float32)
    total = np.maximum(np.diff(word_at), 1)
    text[:, :WORDS] = np.sqrt(counts / total[:, None])
    size = np.maximum(np.diff(at), 1)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        by_class = np.bincount(CLASSES[data[a:b]], minlength=5)[:4]
        own = words[word_at[k] : word_at[k + 1]]
        text[k, WORDS : WORDS + 4] = np.sqrt(by_class / size[k])
        text[k, WORDS + 4] = len(np.unique(own)) / max(len(own), 1)
        text[k, WORDS + 5] = np.log1p(len(own)) / 10
    meta = np.zeros((n, 2 * META + 2), np.float32)
    for base, name in ((0, "lang"), (META, "source")):
        keys, _ = word_hashes(*text_bytes(pa.array(["~" if v is None else "=" + "".join(v.split()) for v in batch.column(name).to_pylist()])))
        meta[np.arange(n), base + (keys % U(META)).astype(np.int64)] = 1
    meta[:, -2], meta[:, -1] = np.log1p(size) / 10, (np.log1p(size) / 10) ** 2
    return text, meta


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            both = [pa.array([r.tobytes() for r in v], pa.binary()) for v in features(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *both], ["doc_id", "label", "words", "meta"])


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)


class Views:
    """Examples of the two views, which grow by pseudo-labels, and the labels held out from them."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        part = np.arange(len(y)) % 4
        fit, calibrate, combine = part < 2, part == 2, part == 3
        if any(len(np.unique(y[p])) < 2 for p in (fit, calibrate, combine)):
            fit = calibrate = combine = np.ones(len(y), bool)
        self.x, self.labels = [[v[fit]] for v in views], [[y[fit]] for _ in views]
        self.held = [([v[p] for v in views], y[p]) for p in (calibrate, combine)]

    def models(self) -> list:
        return [Logistic(np.vstack(x), np.concatenate(y)) for x, y in zip(self.x, self.labels)]

    def learn(self, view: int, vectors: np.ndarray, labels: np.ndarray) -> None:
        """Labels that the other view has given, for this one."""
        self.x[view].append(vectors)
        self.labels[view].append(labels)

    def calibrated(self) -> list:
        """[model of view 0, of view 1, calibration 0, calibration 1]."""
        models, (views, y) = self.models(), self.held[0]
        return [*models, *(Logistic(m.logit(v)[:, None], y, 1e-2) for m, v in zip(models, views))]

    def fitted(self) -> list:
        """What calibrated() gives, and the combination."""
        whole, (others, y_others) = self.calibrated(), self.held[1]
        models, calibrations = whole[:2], whole[2:]
        logits = np.hstack([c.logit(m.logit(v)[:, None])[:, None] for c, m, v in zip(calibrations, models, others)])
        return [*models, *calibrations, Logistic(logits, y_others, 1e-2)]


def surest(logits: list[np.ndarray], quotas: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view, label, rows, how sure) of the surest rows of each view and label, as many as the label's quota, by calibrated logits."""
    for view, own in enumerate(logits):
        for label, quota in enumerate(quotas):
            sign = 1 if label else -1
            open_ = np.flatnonzero(sign * logits[1 - view] > -VETO)
            sure = sign * own[open_]
            if len(sure) > quota:  # with all that are as sure as the last
                best = sure >= np.partition(sure, len(sure) - quota)[len(sure) - quota] if quota else np.zeros(len(sure), bool)
                open_, sure = open_[best], sure[best]
            yield view, label, open_, sure


def _sure(shared):
    """(doc_id, view, label, sure) of the surest documents of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, quotas = shared.value
        for batch in batches:
            parts = [features(batch.slice(a, 256)) for a in range(0, len(batch), 256)]
            logits = [np.concatenate([c.logit(m.logit(p[view])[:, None]) for p in parts] or [np.zeros(0)]) for view, (m, c) in enumerate(zip(whole[:2], whole[2:]))]
            for view, label, at, sure in surest(logits, quotas):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(np.full(len(at), x, np.int32)) for x in (view, label)), pa.array(sure)], ["doc_id", "view", "label", "sure"])

    return run


def score(fitted: list, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    calibrated = [c.logit(m.logit(v)[:, None])[:, None] for m, c, v in zip(fitted[:2], fitted[2:4], views)]
    return 1 / (1 + np.exp(-fitted[4].logit(np.hstack(calibrated))))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, share = shared.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                values = score(fitted, features(part)) if fitted else np.full(len(part), share)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64()), pa.array(values >= 0.5, pa.bool_())], ["doc_id", "score", "kept"])

    return run


def cotrained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> tuple[list | None, float, list[tuple[int, int, int, int]]]:
    """The fitted [model 0, model 1, calibration 0, calibration 1, combination] (None without labels of both classes), the share of
    good labels, and what was exchanged: (round, view that told, label, documents)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    kind = dict(docs.dtypes)["doc_id"]
    known = staged(labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).where("label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    order = F.xxhash64(F.lit(3), "doc_id")

    def vectors(chosen: DataFrame, keys: list[str]) -> list:
        """Rows with both views of the chosen documents; chosen has at most `labelled` or 2 `per_round` rows."""
        found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *keys).agg(F.min(F.struct("text", "lang", "source")).alias("d")).select("doc_id", *keys, "d.*")
        rows = found.withColumn("label", F.col(keys[-1])).mapInArrow(_vectors, f"doc_id {kind}, label double, words binary, meta binary").collect()
        return sorted(rows, key=lambda r: (str(r["doc_id"]), r["label"]))

    chosen = staged(docs.select("doc_id").join(known, "doc_id").distinct().orderBy(order, "doc_id").limit(labelled), "chosen")
    rows = vectors(chosen, ["label"])
    y, fitted, exchanged = np.array([r["label"] for r in rows], float), None, []
    views_of = lambda rows: [np.array([np.frombuffer(r[c], np.float32) for r in rows]) for c in ("words", "meta")]
    if len(np.unique(y)) == 2:
        state, taken = Views(views_of(rows), y), chosen.select("doc_id")
        both = max(2, min(per_round, len(y) // 10))
        good = min(both - 1, max(1, round(both * float(y.mean()))))
        quotas, quota = (both - good, good), F.when(F.col("label") == 1, good).otherwise(both - good)
        for turn in range(rounds):
            free = docs.where("doc_id IS NOT NULL").join(F.broadcast(taken), "doc_id", "left_anti")  # at most `labelled` + 2 `per_round` a round
            sure = free.select(docs.columns).mapInArrow(_sure(spark.sparkContext.broadcast((state.calibrated(), quotas))), f"doc_id {kind}, view int, label int, sure double").distinct()
            top = sure.withColumn("part", F.pmod(order, F.lit(PARTS)))
            for keys in (["view", "label", "part"], ["view", "label"]):  # the surest of each part first, so that no task ranks all
                top = top.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sure"), order, "doc_id"))).where(F.col("place") <= quota)
            # the sign of the label tells the view: 1 + y for view 0, -(1 + y) for view 1
            top = staged(top.select("doc_id", ((F.lit(1.0) + F.col("label")) * (1 - 2 * F.col("view"))).alias("told")), "pseudo-labels")
            rows = vectors(top, ["told"])
            if not rows:
                break
            taken = taken.union(top.select("doc_id"))
            told, (words, meta) = np.array([r["label"] for r in rows]), views_of(rows)
            state.learn(1, meta[told > 0], told[told > 0] - 1)
            state.learn(0, words[told < 0], -told[told < 0] - 1)
            exchanged += [(turn, view, label, int((told == (1 + label) * (1 - 2 * view)).sum())) for view in (0, 1) for label in (0, 1)]
        fitted = state.fitted()
    return fitted, float(y.mean()) if len(y) else 1.0, exchanged


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **how) -> DataFrame:
    """Per row: doc_id, score (of good quality), kept (score of 0.5 or more)."""
    fitted, share, _ = cotrained(docs, labels, doc_id, text, lang, source, **how)
    shared = docs.sparkSession.sparkContext.broadcast((fitted, share))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_score(shared), f"doc_id {kind}, score double, kept boolean").withColumnRenamed("doc_id", doc_id)
