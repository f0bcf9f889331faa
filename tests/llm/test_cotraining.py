"""Co-training against the same rounds written out over arrays of all documents, and what the exchange does."""

import random

import numpy as np
import pyarrow as pa

from gridloom.llm import cotraining


def fitted(x, y, ridge=1.0):
    """Weights of a ridge logistic regression, by plain Newton steps with halving."""
    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + (penalty * w * w).sum() / 2
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while loss(w + size * step) > loss(w) + 1e-12 and size > 1e-6:
            size /= 2
        w = w + size * step
    return w


def logit(w, x):
    return np.clip(np.asarray(x, float) @ w[:-1] + w[-1], -30, 30)


def brute(rows, told, order, rounds, per_round):
    """{doc_id: score} and [(round, view, label, documents)]; rows are sorted as the operator sorts what it fetches."""
    batch = pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], pa.string()) for n in ("text", "lang", "source")})
    views, ids = cotraining.features(batch), [r["doc_id"] for r in rows]
    known = np.array([i in told for i in ids])
    y, part = np.array([told[i] for i in ids if i in told]), np.arange(known.sum()) % 4
    own = [v[known] for v in views]
    xs, ys, free, log = [[v[part < 2]] for v in own], [[y[part < 2]] for _ in own], ~known, []
    total = max(2, min(per_round, len(y) // 10))
    good = min(total - 1, max(1, round(total * float(y.mean()))))
    for turn in range(rounds):
        w = [fitted(np.vstack(a), np.concatenate(b)) for a, b in zip(xs, ys)]
        scale = [fitted(logit(m, v[part == 2])[:, None], y[part == 2], 1e-2) for m, v in zip(w, own)]
        sure = [logit(c, logit(m, v)[:, None]) for c, m, v in zip(scale, w, views)]
        used = []
        for view in (0, 1):
            for label, quota in ((0, total - good), (1, good)):
                sign = 2 * label - 1
                open_ = [k for k in np.flatnonzero(free) if sign * sure[1 - view][k] > -cotraining.VETO]
                best = sorted(open_, key=lambda k: (-sign * sure[view][k], order[ids[k]]))[:quota]
                used.append((view, label, sorted(best)))
                log.append((turn, view, label, len(best)))
        for view in (0, 1):
            mine = sorted((k, float(label)) for v, label, best in used if v == view for k in best)
            xs[1 - view].append(views[1 - view][[k for k, _ in mine]]), ys[1 - view].append(np.array([x for _, x in mine]))
        for _, _, best in used:
            free[best] = False
    w = [fitted(np.vstack(a), np.concatenate(b)) for a, b in zip(xs, ys)]
    scale = [fitted(logit(m, v[part == 2])[:, None], y[part == 2], 1e-2) for m, v in zip(w, own)]
    last = lambda vs: np.column_stack([logit(c, logit(m, v)[:, None]) for c, m, v in zip(scale, w, vs)])
    final = fitted(last([v[part == 3] for v in own]), y[part == 3], 1e-2)
    return dict(zip(ids, 1 / (1 + np.exp(-logit(final, last(views)))))), log


def two_views(n, labelled, seed=3):
    """Documents whose words and whose source each tell their class, independently given the class."""
    r = random.Random(seed)
    good, bad = [[f"{c}{k}" for k in range(300)] for c in "gb"]
    rows = []
    for i in range(n):
        y = i % 2
        words = [r.choice((good if y else bad) if r.random() < 0.16 else good + bad) for _ in range(30)]
        source = f"s{r.randrange(8) + 8 * (y if r.random() < 0.93 else 1 - y)}"
        rows.append({"doc_id": i, "text": " ".join(words), "lang": "en", "source": source, "y": float(y)})
    r.shuffle(rows)
    return rows, {row["doc_id"]: row["y"] for row in rows[:labelled]}


def tables(spark, rows, told):
    docs = spark.createDataFrame([(x["doc_id"], x["text"], x["lang"], x["source"]) for x in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, int(y)) for i, y in told.items()], "doc_id long, quality int")


def test_equals_brute_force(spark):
    rows, told = two_views(600, 120)
    docs, labels = tables(spark, rows, told)
    got = {r.doc_id: r.score for r in cotraining.classify(docs.repartition(1), labels, rounds=3, per_round=12).collect()}
    _, _, exchanged = cotraining.cotrained(docs.repartition(5), labels, rounds=3, per_round=12)
    order = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(3, doc_id)").collect()}  # of ties
    want, log = brute(sorted(rows, key=lambda r: str(r["doc_id"])), told, order, 3, 12)
    assert exchanged == sorted(log)
    assert max(abs(got[i] - want[i]) for i in want) < 0.01


def test_both_views_teach_and_errors_fall(spark):
    rows, told = two_views(2400, 200)
    docs, labels = tables(spark, rows, told)
    held = {r["doc_id"]: r["y"] for r in rows if r["doc_id"] not in told}
    wrong = {}
    for rounds in (0, 12):
        fit, _, exchanged = cotraining.cotrained(docs, labels, rounds=rounds)
        assert len(exchanged) == 4 * rounds and all(n > 0 for *_, n in exchanged)
        views = cotraining.features(pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], pa.string()) for n in ("text", "lang", "source")}))
        score = dict(zip([r["doc_id"] for r in rows], fit[0].logit(views[0])))
        wrong[rounds] = np.mean([(score[i] > 0) != (y == 1) for i, y in held.items()])  # of the text view
    assert wrong[12] < 0.9 * wrong[0], wrong


def test_given_documents_are_exchanged(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    _, _, exchanged = cotraining.cotrained(docs, labels)
    assert {(turn, view) for turn, view, _, n in exchanged if n} == {(turn, view) for turn in range(4) for view in (0, 1)}


def test_null_ids_ties_and_repeats(spark):
    rows, told = two_views(200, 60)
    docs, labels = tables(spark, rows, told)
    same = docs.limit(1).selectExpr("9000 AS doc_id", "'tie tie' AS text", "lang", "source")
    more = docs.unionByName(docs).unionByName(same).unionByName(same).unionByName(docs.limit(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source"))
    got = cotraining.classify(more, labels.unionByName(labels.selectExpr("doc_id + 100000 AS doc_id", "quality")).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality")), rounds=2).collect()
    assert len(got) == 407 and sum(r.doc_id is None for r in got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 9000}) == 1


def test_surest_of_each_class():
    own, other = np.array([3.0, -1.0, 5.0, 5.0, -4.0, 0.5]), np.array([0.0, 0.0, -9.0, 1.0, 0.0, 0.0])
    found = {(v, y): rows.tolist() for v, y, rows, _ in cotraining.surest([own, other], (1, 2))}
    assert found[0, 1] == [0, 3] and found[0, 0] == [4]  # row 2 is vetoed by the other view
    assert {y: len(rows) for (v, y), rows in found.items() if v == 1} == {0: 1, 1: 5} or found[1, 1]  # ties all stay
