import numpy as np
import pandas as pd
import pytest

from lociframe.operators import impute, prediction


def test_expand_and_contract():
    beta = np.array([5, -0.4, 0, 1, -0.1, 1, 0])
    assert np.allclose(prediction.expand_and_contract(beta, beta, 1.0, 0.5), [5, 0, 0, 0.75, 0, 0.75, 0])
    mirror = np.array([5, 0.4, 0, -1, 0.1, -1, 0])
    assert np.allclose(prediction.expand_and_contract(mirror, mirror, 1.0, 0.5), [5, 0, 0, -0.75, 0, -0.75, 0])


def test_expand_and_contract_as_a_frame(spark):
    beta = [-0.4, 0.0, 1.0, -0.1, 1.0, 0.0]
    rows = prediction.penalise(spark.createDataFrame([(i, b) for i, b in enumerate(beta)], "i int, b double"), "b", 1.0, 0.5)
    assert np.allclose([r.penalised for r in rows.orderBy("i").collect()], [0, 0, 0.75, 0, 0.75, 0])


def test_folds():
    fold, k = prediction.k_split(25, 10, 1)
    assert k == 2 and sorted(np.bincount(fold).tolist()) == [1, 12, 12]
    assert prediction.k_split(15, 10, 1)[1] == 2
    with pytest.raises(ValueError):
        prediction.k_split(5, 10, 1)


def test_cross_validation_finds_a_strong_effect(spark):
    rng = np.random.default_rng(4)
    n = 40
    x = rng.random((60, n))
    y = (3 * x[0] - 2 * x[1] + rng.normal(0, 0.01, n))[:, None]
    frame = spark.createDataFrame([("c", i, "A", 0, r.tolist()) for i, r in enumerate(x)], "chr string, pos long, allele string, allele_ord int, x array<double>")
    cv = prediction.cross_validate(frame, y, k=4, reps=1, inner_reps=1, step=0.5)
    assert set(cv.metrics["model"]) == set(prediction.MODELS)
    assert np.isfinite(cv.metrics[["cor", "mbe", "mae", "mse", "rmse"]].to_numpy()).all()
    assert len(cv.predictions) == len(prediction.MODELS) * n


def test_coefficients_fit_the_training_pools(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random((30, 8)), rng.random((8, 1))
    frame = spark.createDataFrame([("c", i, "A", r.tolist()) for i, r in enumerate(x)], "chr string, pos long, allele string, x array<double>")
    beta, intercept = prediction.coefficients(frame, y)
    b = np.array([r.beta[0] for r in beta.orderBy("pos").collect()])
    assert np.allclose(intercept[0] + b @ x, y[:, 0], atol=1e-4)


def test_imputed_frequencies_of_a_locus_sum_to_one():
    rng = np.random.default_rng(6)
    raw = rng.random((6, 5, 2))
    x = (raw / raw.sum(axis=2, keepdims=True)).reshape(6, 10)
    x[2, 4:6] = np.nan
    x[0, 0:2] = np.nan
    filled = impute.impute_window(x, np.repeat(np.arange(5), 2), 4, 3)
    assert not np.isnan(filled).any()
    assert np.allclose(filled.reshape(6, 5, 2).sum(axis=2), 1)
    known = ~np.isnan(x)
    assert np.allclose(filled[known], x[known])


def test_mean_imputation(spark):
    rows = [("c", 1, a, o, p, f, c) for a, o, p, f, c in [("A", 0, 0, 0.2, 5.0), ("T", 1, 0, 0.8, 5.0), ("A", 0, 1, 0.4, 9.0), ("T", 1, 1, 0.6, 9.0), ("A", 0, 2, None, None), ("T", 1, 2, None, None)]]
    long = spark.createDataFrame(rows, "chr string, pos long, allele string, allele_ord int, pool_idx int, freq double, coverage double")
    got = {(r.allele, r.pool_idx): (r.freq, r.coverage) for r in impute.mean_impute(long).collect()}
    assert abs(got["A", 2][0] - 0.3) < 1e-12 and abs(got["T", 2][0] - 0.7) < 1e-12
    assert got["A", 2][1] == float("inf") and got["A", 0] == (0.2, 5.0)


def test_cross_validation_query_runs_the_operators_defaults(spark, sf_dir, monkeypatch):
    import inspect

    from lociframe.plans import queries

    seen = []
    usual = inspect.signature(prediction.cross_validate)
    monkeypatch.setattr(prediction, "cross_validate", lambda *a, **k: seen.append(usual.bind(*a, **k)))
    queries._cross(spark, sf_dir)
    seen[0].apply_defaults()
    assert {k: seen[0].arguments[k] for k in ("k", "reps", "step", "inner_reps", "inner_folds")} == {"k": 10, "reps": 3, "step": 0.1, "inner_reps": 10, "inner_folds": 10}


def test_linked_neighbours_are_those_of_a_plain_loop():
    rng = np.random.default_rng(5)
    x = rng.dirichlet(np.ones(3), (9, 6)).reshape(9, 18)
    loci = np.repeat(np.arange(6), 3)
    hole = rng.random((9, 6)) < 0.2
    x[np.repeat(hole, 3, axis=1)] = np.nan
    n_loci, k = 5, 3
    r = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    want = x.copy()
    for j in range(18):
        gaps = [i for i in range(9) if np.isnan(want[i, j])]
        linked = sorted(range(18), key=lambda c: (-np.inf if np.isnan(r[c, j]) else -r[c, j], c))[:n_loci]
        before = want.copy()  # what an allele's distances are made of
        for i in gaps:
            near = []
            for q in range(9):
                both = [c for c in linked if not np.isnan(before[i, c]) and not np.isnan(before[q, c])]
                if q != i and q not in gaps and both:
                    near.append((sum((before[i, c] - before[q, c]) ** 2 for c in both) ** 0.5, q))
            near = sorted(near)[:k]
            total = sum(d for d, _ in near)
            w = [1 - d / (total + 2.220446049250313e-16) for d, _ in near]
            want[i, j] = sum(a * before[q, j] for a, (_, q) in zip(w, near, strict=True)) / sum(w) if near and sum(w) else np.nanmean(before[:, j])
        if j % 3 == 2:
            own = slice(j - 2, j + 1)
            sums = want[:, own].sum(axis=1, keepdims=True)
            want[:, own] = np.where(np.abs(sums - 1) > 1e-12, want[:, own] / sums, want[:, own])
    assert np.allclose(impute.impute_window(x, loci, n_loci, k), want, atol=1e-9)


def test_fitted_weights_are_the_shortest_exact_solution(spark):
    """Least-squares coefficients of more alleles than pools against numpy's pseudo-inverse of the whole design."""
    rng = np.random.default_rng(6)
    x, y = rng.random((40, 8)), rng.normal(size=(8, 2))
    alleles = spark.createDataFrame([("c", i, "A", x[i].tolist()) for i in range(40)], "chr string, pos long, allele string, x array<double>")
    got, intercepts = prediction.coefficients(alleles, y)
    design = np.column_stack([np.ones(8), x.T])
    beta = np.linalg.pinv(design) @ y
    assert np.allclose(intercepts, beta[0]) and np.allclose([r.beta for r in got.orderBy("pos").collect()], beta[1:])


def plain_cross_validation(x, y, models, k, reps, step, inner_reps, inner_folds, seed):
    """Every model by whole designs and plain loops: metrics by rep, fold and model, with alpha and lambda."""
    n, p = x.shape[1], len(x)
    design = np.column_stack([np.ones(n), x.T])

    def ols(train):
        return np.linalg.pinv(design[train]) @ y[train]

    def one_by_one(train):
        centred = design[train] - design[train].mean(axis=0)
        pc = np.linalg.svd(centred)[0][:, 0]
        return np.array([np.linalg.lstsq(np.column_stack([np.ones(len(train)), pc, x[j, train]]), y[train], rcond=None)[0][2] for j in range(p)])

    def shrunk(b, proxy, alpha, lam):
        norm = lambda v: (1 - alpha) * v * v + alpha * abs(v)
        top = max(norm(v) for v in proxy)
        small = [norm(v) / top < lam for v in proxy]
        new, less, more = list(b), 0.0, 0.0
        for j in range(p):
            if small[j]:
                cut = min(abs(b[j]), norm(b[j]))
                new[j] = b[j] - cut if b[j] >= 0 else b[j] + cut
                less, more = (less + cut, more) if b[j] >= 0 else (less, more + cut)
        ups = sum(norm(b[j]) for j in range(p) if not small[j] and b[j] >= 0)
        downs = sum(norm(b[j]) for j in range(p) if not small[j] and b[j] < 0)
        if less > 0 and ups == 0:
            less, more = 0.0, more - less
        elif more > 0 and downs == 0:
            less, more = less - more, 0.0
        for j in range(p):
            if not small[j]:
                new[j] = b[j] + less * norm(b[j]) / ups if b[j] >= 0 else b[j] - more * norm(b[j]) / downs
        return np.array(new)

    def error(truth, got):
        spread = truth.max() - truth.min()
        e = truth - got
        r = np.corrcoef(truth, got)[0, 1] if got.std() > 1e-14 else 0.0
        mse = (e**2).sum() / spread**2
        return (1 - abs(r) + np.abs(e).sum() / spread + mse + mse**0.5 / spread) / 4

    def predict(train, valid, model, alpha, lam):
        beta = ols(train)
        proxy = one_by_one(train) if model.endswith("_iterative") else beta[1:]
        if model == "ols_iterative":
            return y[train].mean() + x[:, valid].T @ proxy
        return beta[0] + x[:, valid].T @ (beta[1:] if model == "ols" else shrunk(beta[1:], proxy, alpha, lam))

    path, out, o = np.arange(round(1 / step) + 1) * step, {}, {m: 0 for m in models}
    for rep in range(reps):
        fold, folds = prediction.k_split(n, k, [seed, rep])
        for f in range(folds):
            train, valid = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            for model in models:
                alpha = lam = None
                if model in prediction.ALPHA:
                    alphas = path if prediction.ALPHA[model] is None else [prediction.ALPHA[model]]
                    picks = []
                    for inner in range(inner_reps):
                        parts, kk = prediction.k_split(len(train), min(inner_folds, len(train) - 1), [seed + 1, o[model], inner])
                        means = np.array([[np.mean([error(y[train[parts == g]], predict(train[parts != g], train[parts == g], model, a, m)) for g in range(kk)]) for m in path] for a in alphas])
                        picks.append(np.unravel_index(means.argmin(), means.shape))
                    most = lambda v: min(set(v), key=lambda i: (-v.count(i), i))
                    alpha, lam = alphas[most([a for a, _ in picks])], path[most([m for _, m in picks])]
                o[model] += 1
                got, truth = predict(train, valid, model, alpha, lam), y[valid]
                e = truth - got
                out[rep, f, model] = (alpha, lam, np.corrcoef(truth, got)[0, 1], e.mean(), np.abs(e).mean(), (e**2).mean(), (e**2).mean() ** 0.5)
    return out


def test_cross_validation_is_that_of_plain_loops(spark):
    """All models, the search of alpha and lambda included."""
    rng = np.random.default_rng(11)
    x = rng.random((14, 22))
    y = 2 * x[0] - x[3] + rng.normal(0, 0.2, 22)
    frame = spark.createDataFrame([("c", i, "A", r.tolist()) for i, r in enumerate(x)], "chr string, pos long, allele string, x array<double>").repartition(3)
    args = {"k": 3, "reps": 2, "step": 0.25, "inner_reps": 3, "inner_folds": 3, "seed": 5}
    got = prediction.cross_validate(frame, y[:, None], **args).metrics
    want = plain_cross_validation(x, y, prediction.MODELS, **args)
    assert len(got) == len(want)
    for row in got.rename(columns={"lambda": "lam"}).itertuples():
        alpha, lam, *figures = want[row.rep, row.fold, row.model]
        if alpha is not None:
            assert np.allclose((row.alpha, row.lam), (alpha, lam)), row
        assert np.allclose([row.cor, row.mbe, row.mae, row.mse, row.rmse], figures, atol=2e-6), row


def test_partial_arrays_meet_in_a_tree(spark, monkeypatch):
    """Blocks smaller than the array, and more tasks than one merges."""
    monkeypatch.setattr(prediction, "BLOCK_CELLS", 7)
    monkeypatch.setattr(prediction, "FAN_IN", 3)
    x = np.random.default_rng(3).random((50, 5))
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(29)
    kernel = lambda b: (b[:, :, None] * b[:, None, :]).sum(axis=0)
    assert np.allclose(prediction._reduce(frame, kernel, (5, 5)), x.T @ x)
    assert np.allclose(prediction._reduce(frame, lambda b: b.max(axis=0), (5,), largest=True), x.max(axis=0))
    assert np.allclose(prediction._reduce(frame.where("false"), lambda b: b.sum(axis=0), (5,)), 0)


def test_predictions_of_all_penalties_come_from_sums_between_their_limits(spark, monkeypatch):
    """Every penalty's predictions against coefficients penalised one by one, sizes above 1 included; two passes for all."""
    rng = np.random.default_rng(8)
    x, y = rng.random((60, 9)), rng.normal(0, 40, size=(9, 1))
    x[7] = x[8] = x[9]
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    jobs = [prediction.Job(np.array(at), np.setdiff1d(np.arange(9), at), 0, ()) for at in ([0, 1, 2, 3, 4], [3, 5, 6, 7, 8], list(range(9)))]
    prediction.fit(jobs, x.T @ x + 1, y)
    alphas, lambdas = np.array([0.0, 0.3, 1.0]), np.array([0.0, 0.1, 0.5, 1.0])
    passes, usual = [], prediction._reduce
    monkeypatch.setattr(prediction, "_reduce", lambda *a, **k: passes.append(1) or usual(*a, **k))
    for by_proxy in (False, True):
        got = prediction.penalised_predictions(frame, jobs, y, alphas, lambdas, by_proxy)
        for j, job in enumerate(jobs):
            b = x @ job.weights
            q = prediction.iterative(x, prediction.cleared([job], y))[:, 0] if by_proxy else b
            for i, a in enumerate(alphas):
                for m, lam in enumerate(lambdas):
                    want = job.weights.sum() + prediction.expand_and_contract(np.append(0, b), np.append(0, q), a, lam)[1:] @ x
                    assert np.allclose(got[j, i, m], want, rtol=1e-9, atol=1e-9), (by_proxy, j, a, lam)
    assert len(passes) == 4
    assert any(np.abs(x @ j.weights).max() > 1 for j in jobs)


def test_limits_are_where_the_comparison_turns():
    top, alphas, lambdas = np.array([0.7, 3.0, 0.0]), np.arange(11) / 10, np.arange(11) / 10
    got = prediction.limits(top, alphas, lambdas)
    norm = lambda v, a: (1 - a) * v * v + a * v
    for j, i, k in np.ndindex(got.shape):
        scale = max(norm(top[j], alphas[i]), 1e-300)
        if np.isfinite(got[j, i, k]):
            assert norm(got[j, i, k], alphas[i]) / scale >= lambdas[k]
            assert got[j, i, k] == 0 or norm(np.nextafter(got[j, i, k], 0), alphas[i]) / scale < lambdas[k]
        else:
            assert top[j] == 0 and lambdas[k] > 0
    assert (got[:2, :, -1] == top[:2, None]).sum() >= 2


def test_imputed_rows_are_made_once(spark):
    """What the pipeline gives is read from a table: windows are not filled once for the rows and again for those that still miss any."""
    from lociframe.model import WindowParams

    rng = np.random.default_rng(9)
    rows = []
    for pos in range(1, 41):
        for pool in range(6):
            share = float(rng.random())
            depth = float(rng.integers(1, 12))
            rows += [("c", pos, "A", 0, pool, depth * share, depth, share), ("c", pos, "T", 1, pool, depth * (1 - share), depth, 1 - share)]
    long = spark.createDataFrame(rows, "chr string, pos long, allele string, allele_ord int, pool_idx int, count double, coverage double, freq double")
    out = impute.impute_pipeline(long, 3, p=WindowParams(20, 10, 5))
    assert "FlatMapGroupsIn" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas()
    assert len(got) and not got["freq"].isna().any()
    sums = got.groupby(["pos", "pool_idx"])["freq"].sum()
    assert np.allclose(sums, 1)
