"""DataFrame plans against the kernels, and operators on tables."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratestep.functions import planes
from ratestep.functions import segments as g
from ratestep.functions.special import logsumexp
from ratestep.operators import baselines, fit, grid, live, tree
from ratestep.plans import exact
from ratestep.schema import checked
from ratestep.sources import axis, files, generators


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), k, float(x), float(e)) for i in range(3) for k, (x, e) in enumerate(zip(rng.poisson(np.repeat([2, 7, 1], 5 + i)), rng.uniform(0.5, 2, 15 + 3 * i), strict=True))]
    return spark.createDataFrame(rows, "series_id string, k int, y double, e double").cache()


def model(pdf):
    pdf = pdf.sort_values("k")
    return g.Poisson.weak_prior(pdf.y.to_numpy(), pdf.e.to_numpy())


@pytest.mark.parametrize("parts", [1, 5])
def test_both_engines_equal_the_kernel(series, parts):
    data = series.repartition(parts)
    rel = exact.fit(data, "poisson", 4, weak=1.0)
    a = exact.rates(exact.bin_posterior(rel, "poisson")).toPandas()
    b = fit.by_k(fit.fit(exact.gather(data, weak=1.0), "poisson", 4)).toPandas()
    ev = exact.by_m(rel).toPandas()
    for name, part in series.toPandas().groupby("series_id"):
        f = g.fit(model(part), 4)
        for got in (a, b):
            x = got[got.series_id == name].sort_values("k")
            assert x.rate.to_numpy() == pytest.approx(f.rate, rel=1e-10)
            assert x.rate_std.to_numpy() == pytest.approx(f.rate_std, rel=1e-8)
            assert x.p_boundary.to_numpy()[:-1] == pytest.approx(f.boundary_posterior, abs=1e-10)
        assert ev[ev.series_id == name].sort_values("m").log_evidence.to_numpy() == pytest.approx(f.log_evidence, rel=1e-11)


def test_a_series_of_one_interval_and_a_capped_number_of_boundaries(spark):
    one = spark.createDataFrame([("a", 0, 3.0, 1.0), ("b", 0, 1.0, 1.0), ("b", 1, 4.0, 1.0)], "series_id string, k int, y double, e double")
    rel = exact.by_m(exact.fit(one, "poisson", 5, weak=1.0)).toPandas()
    assert rel.groupby("series_id").m.max().to_dict() == {"a": 0, "b": 1}
    out = fit.fit(exact.gather(one, weak=1.0), "poisson", 5).toPandas().set_index("series_id")
    assert len(out.loc["a", "p_boundary"]) == 0 and len(out.loc["b", "log_evidence"]) == 2


def test_the_plan_of_a_fit_gathers_once_and_runs_no_python(spark, series):
    plan = exact.by_m(exact.fit(series, "poisson", 3, weak=1.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "MapInArrow" not in plan


def test_derived_operators(series):
    rows = exact.gather(series, weak=1.0)
    parts = {n: model(p) for n, p in series.toPandas().groupby("series_id")}
    cyc = fit.by_k(fit.fit_cyclic(rows, "poisson", 3)).toPandas()
    lat = fit.latency(rows, "poisson", 4.0, 3).toPandas()
    above = fit.above_level(rows, "poisson", 4.0, 3).toPandas()
    pos = fit.boundary_positions(rows, "poisson", 2).toPandas()
    for n, m in parts.items():
        assert cyc[cyc.series_id == n].sort_values("k").rate.to_numpy() == pytest.approx(g.fit_cyclic(m, 3).rate, rel=1e-10)
        assert lat[lat.series_id == n].sort_values("k").p.to_numpy() == pytest.approx(g.latency_posterior(m, 4.0, 3), abs=1e-12)
        assert above[above.series_id == n].sort_values("k").p.to_numpy() == pytest.approx(g.above_level(m, 4.0, 3), abs=1e-12)
        assert pos[pos.series_id == n].sort_values("j")["mean"].to_numpy() == pytest.approx(g.position_moments(g.boundary_positions(m, 2))[0], abs=1e-10)
    best = fit.best_prior_grid(rows, "poisson", [(0.5, 0.5), (1, 1), (2, 2)], 3, scaled=True).toPandas().set_index("series_id")
    for n, m in parts.items():
        want = max((g.log_marginal(m.with_prior(m.alpha * a, m.beta * a), 3), m.alpha * a) for a in (0.5, 1, 2))
        assert (best.loc[n, "log_marginal"], best.loc[n, "p1"]) == pytest.approx(want)


def test_replays(series):
    rows = exact.gather(series, weak=1.0)
    a = live.replay_online(rows, "poisson", 4).toPandas()
    s = live.replay_stream(rows, "poisson", expected_run_length=10.0, lag=3).toPandas()
    for n, part in series.toPandas().groupby("series_id"):
        f = g.fit(model(part), 4, min_m_posterior=0)
        last = a[a.series_id == n].sort_values("k").iloc[-1]
        assert (last.rate, last.rate_std) == pytest.approx((f.rate[-1], f.rate_std[-1]), rel=1e-8)
        x = s[s.series_id == n].sort_values("k")
        assert x.logpmf.cumsum().to_numpy() == pytest.approx(x.log_marginal.to_numpy(), abs=1e-9) and x.pit.between(0, 1).all()


def test_spike_counts_and_their_errors(spark, tmp_path):
    rows = [("a", "t1", 0), ("a", "t1", 2), ("a", "t2", 2), ("a", "t3", None), ("a", "t2", 9)]
    trials = spark.createDataFrame(rows, "series_id string, trial_id string, t int")
    got = {r.k: (r.s, r.g) for r in axis.spike_counts(trials, 0, 3).collect()}
    assert got == {0: (1.0, 2.0), 1: (0.0, 3.0), 2: (2.0, 1.0), 3: (0.0, 3.0)}
    with pytest.raises(PySparkException, match="two events of one trial"):
        axis.spike_counts(trials.union(spark.createDataFrame([("a", "t1", 0)], trials.schema)), 0, 3).collect()
    (tmp_path / "x.txt").write_text("Stim 3 -1\t5\n\nStim\nOther 7\n")
    back = files.read_trials(spark, str(tmp_path / "x.txt"))
    assert sorted((r.series_id, r.t) for r in back.where("t is not null").collect()) == [("Other", 7), ("Stim", -1), ("Stim", 3), ("Stim", 5)]
    assert back.select("trial_id").distinct().count() == 3


def test_checks_raise(spark):
    bad = spark.createDataFrame([("a", 0, 1.0, 0.0)], "series_id string, k int, y double, e double")
    with pytest.raises(PySparkException, match="without exposure"):
        checked(bad).collect()
    with pytest.raises(PySparkException, match="not negative"):
        checked(bad.withColumns({"y": F.lit(-1.0), "e": F.lit(1.0)})).collect()


def test_axis_changes(series):
    part = series.where("series_id = '0'")
    folded = {r.k: r.y for r in axis.fold_periods(part, 5).collect()}
    y = part.toPandas().sort_values("k").y.to_numpy()
    assert [folded[k] for k in range(5)] == pytest.approx(y.reshape(3, 5).sum(0))
    twice = axis.reverse(axis.reverse(part, 15), 15)
    assert sorted(twice.collect()) == sorted(part.collect())
    around = axis.rotate(axis.rotate(part, 15, 4), 15, -4)
    assert sorted(around.collect()) == sorted(part.collect())


def test_files_round_trip(spark, series, tmp_path):
    files.write_table(series, str(tmp_path / "j"), "json")
    assert spark.read.schema(series.schema).json(str(tmp_path / "j")).count() == series.count()
    files.write_rates(fit.by_k(fit.fit(exact.gather(series, weak=1.0), "poisson", 2)), str(tmp_path / "r"))
    line = spark.read.text(str(tmp_path / "r")).first()[0].split("\t")
    assert len(line) == 5
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.csv").write_text("time,latitude,longitude\n2024-01-01T00:00:00Z,10,20\n")
    r = files.read_events(spark, str(tmp_path / "e"), level=4).first()
    assert len(r.cell) == 4 and set(r.cell) <= set("0123")
    assert generators.response_trials(spark).select("trial_id").distinct().count() == 30


def test_grids(spark):
    cells = generators.planted_grid(spark, 5, 4)
    p = cells.toPandas()
    y = np.zeros((5, 4))
    y[p.r, p.c] = p.y
    ev, rates = grid.two_level(cells, 1.0, 1.0, 3, 3)
    total, rate, sd = planes.two_level(y, np.ones((5, 4)), 1.0, 1.0, 3, 3)
    r = rates.toPandas()
    got, spread = np.zeros((5, 4)), np.zeros((5, 4))
    got[r.r, r.c], spread[r.r, r.c] = r.rate, r.rate_std
    assert ev.first().log_marginal == pytest.approx(total)
    assert got == pytest.approx(rate) and spread == pytest.approx(sd)
    assert grid.guillotine(cells, 1.0, 1.0, 0.6).first().log_evidence == pytest.approx(planes.guillotine_by_recursion(y, np.ones((5, 4)), 1.0, 1.0, 0.6))


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (2, 2), (2, 3), (3, 2)])
def test_guillotine_against_all_trees(shape):
    """A direction is drawn first, then a cut in it."""
    y = np.random.default_rng(3).poisson(2.0, shape).astype(float)
    e = np.random.default_rng(4).uniform(0.5, 2, shape)
    trees = planes.cut_trees(*shape, 0.6)
    assert sum(np.exp(p) for p, _ in trees) == pytest.approx(1)
    want = logsumexp(np.array([p + sum(float(planes.gamma_poisson(y[a:b, c:d].sum(), e[a:b, c:d].sum(), 1.5, 0.7)) for a, b, c, d in bins) for p, bins in trees]))
    assert planes.guillotine(y, e, 1.5, 0.7, 0.6) == pytest.approx(want, abs=1e-11)
    assert planes.guillotine_by_recursion(y, e, 1.5, 0.7, 0.6) == pytest.approx(want, abs=1e-11)


def test_smoothing_by_transforms():
    y = np.random.default_rng(5).poisson(3, 50).astype(float)
    k = np.arange(50)
    w = np.exp(-0.5 * ((k[:, None] - k) / 2.5) ** 2)
    assert planes.kernel_smooth(y, 2.5) == pytest.approx(w @ y / w.sum(1), abs=1e-10)
    t = np.repeat(k, y.astype(int)).astype(float)
    d = t[:, None] - t
    conv, kern = np.exp(-(d**2) / 25) / (2 * np.sqrt(np.pi) * 2.5), np.exp(-(d**2) / 12.5) / (np.sqrt(2 * np.pi) * 2.5)
    np.fill_diagonal(kern, 0)
    assert planes.kernel_cost(y, 3, 2.5) == pytest.approx((conv.sum() - 2 * kern.sum()) / 9, rel=1e-9)
    assert np.isfinite(planes.kernel_cost(np.ones(100_000), 1, 3.0))


def test_counting_and_merging():
    assert [planes.tilings(n, n) for n in (1, 2, 3, 4)] == [1, 2 ** 3, 322, 70878]
    y = np.array([5.0, 6, 5, 50, 52, 51])
    label, gain = planes.merge_bins(y, np.ones(6), [(i, i + 1) for i in range(5)], 1.0, 0.1)
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3] and gain > 0


def test_tree_equals_enumeration(spark):
    nodes = [("r", None, None, None), ("a", "r", None, None), ("b", "r", 0.0, 2.0), ("c", "r", None, None), ("a1", "a", 3.0, 1.0), ("a2", "a", 9.0, 1.0), ("c1", "c", 1.0, 1.5), ("c2", "c", 2.0, 1.0)]
    df = spark.createDataFrame(nodes, "node string, parent string, y double, exposure double")
    kids = {"r": ["a", "b", "c"], "a": ["a1", "a2"], "c": ["c1", "c2"]}
    own = {n: (y or 0.0, e or 0.0) for n, _, y, e in nodes}

    def total(n):
        return tuple(np.sum([total(k) for k in kids[n]], axis=0)) if n in kids else own[n]

    def ways(n):
        """(log prior, bins) of every partition below n."""
        if n not in kids or total(n)[0] == 0:
            return [(0.0, (n,))]
        out = [(np.log(0.4), (n,))]
        for combo in itertools.product(*(ways(k) for k in kids[n])):
            out.append((np.log(0.6) + sum(p for p, _ in combo), sum((b for _, b in combo), ())))
        return out

    rows = [(p + sum(float(planes.gamma_poisson(*total(b), 2.0, 0.5)) for b in bins), bins) for p, bins in ways("r")]
    lp = np.array([p for p, _ in rows])
    z = g.logsumexp(lp)
    w = np.exp(lp - z)
    ev = {r.node: r.log_z for r in tree.tree_evidence(df, 2.0, 0.5, 0.4).collect()}
    assert ev["r"] == pytest.approx(z)
    post = tree.tree_posterior(df, 2.0, 0.5, 0.4)
    for r in post.collect():
        assert r.p_bin == pytest.approx(sum(x for x, (_, bins) in zip(w, rows, strict=True) if r.node in bins), abs=1e-12)
    best = {r.node for r in tree.best_partition(df, 2.0, 0.5, 0.4).collect()}
    assert best == set(rows[int(lp.argmax())][1])
    places = spark.createDataFrame([("p", "a1"), ("q", "b")], "place string, node string")
    got = {r.place: r.node for r in tree.lookup(df, spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), places, 3).collect()}
    assert got == {"p": "a", "q": "b"}
    rates = {r.node: r.rate for r in tree.leaf_rates(post, 3).collect()}
    anc = {"a1": ["a1", "a", "r"], "b": ["b", "r"]}
    for leaf, up in anc.items():
        want = sum(x * next((total(b)[0] + 2.0) / (total(b)[1] + 0.5) for b in bins if b in up) for x, (_, bins) in zip(w, rows, strict=True))
        assert rates[leaf] == pytest.approx(want)
    grid_ = [(2.0, 0.5, 0.4), (1.0, 1.0, 0.5)]
    assert {(r.alpha, r.rho): r.log_z for r in tree.prior_search(df, grid_).collect()}[(2.0, 0.4)] == pytest.approx(z)


def test_baselines(spark, series):
    part = series.where("series_id = '0'")
    h = {r.bin: r.rate for r in baselines.histogram(part, 5).collect()}
    y = part.toPandas().sort_values("k").y.to_numpy()
    assert [h[b] for b in range(3)] == pytest.approx(y.reshape(3, 5).mean(1))
    best = baselines.best_width(series, [1, 2, 5]).toPandas()
    assert set(best.width) <= {1, 2, 5}
    assert baselines.best_bandwidth(exact.gather(series, weak=1.0), [1.0, 3.0], 10).count() == 3
    u = spark.createDataFrame([("a", (i + 0.5) / 100) for i in range(100)], "series_id string, pit double")
    assert baselines.ks_distance(u).first().ks == pytest.approx(0.005)


def test_sql_surface(spark, series):
    from ratestep.functions import sql

    sql.register(spark)
    series.createOrReplaceTempView("series")
    r = spark.sql("SELECT lgamma(5.5) a, betainc(2.0, 3.0, 0.4) b, logsumexp(y) c FROM series WHERE series_id = '0' GROUP BY 1, 2").first()
    assert r.a == pytest.approx(3.9578139676187165) and r.b == pytest.approx(0.5248) and np.isfinite(r.c)
    out = spark.sql("SELECT * FROM bin_fit(TABLE(series), 3)").toPandas()
    for n, part in series.toPandas().groupby("series_id"):
        assert out[out.series_id == n].sort_values("k").rate.to_numpy() == pytest.approx(g.fit(model(part), 3).rate)


def test_command_line(spark, tmp_path):
    from ratestep.__main__ import REPORTS, main, options, report

    rng = np.random.default_rng(0)
    hits = rng.random((12, 20)) < np.repeat([0.05, 0.5], 10)
    (tmp_path / "t.txt").write_text("".join("cell " + " ".join(str(k - 5) for k in np.flatnonzero(h)) + "\n" for h in hits))
    base = [str(tmp_path / "t.txt"), "--start", "-5", "--end", "14", "--max-boundaries", "3"]
    for name in REPORTS:
        assert report(spark, options().parse_args([*base, "--report", name, "--train", "6"])).count() > 0
    f = g.fit(g.Bernoulli(hits.sum(0), 12 - hits.sum(0)), 3)
    out = report(spark, options().parse_args([*base, "--fano"])).orderBy("k").toPandas()
    assert out.k.tolist() == list(range(-5, 15)) and out.rate.to_numpy() == pytest.approx(f.rate, rel=1e-10) and (out.fano + out.rate).to_numpy() == pytest.approx(np.ones(20))
    main([*base, "--report", "evidence", "--out", str(tmp_path / "out")])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4
