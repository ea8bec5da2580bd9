"""Run metrics against numpy, and null where a cell is too short."""

import numpy as np
import pytest

from probanda.functions import metrics
from probanda.plans import panel

RNG = np.random.default_rng(3)
STEPS, BURSTS, EPISODES = 60, 6, 5
SERIES = {k: RNG.normal(size=STEPS) for k in ("online_max_q_per_step", "online_min_q_per_step", "online_std_q_per_step", "online_mean_q_per_step", "target_max_q_per_step", "target_q_at_online_argmax_per_step", "td_error", "ep_return", "online_top12_margin_per_step")}
SERIES |= {k: RNG.integers(0, 4, STEPS).astype(float) for k in ("state_hash_per_step", "online_argmax_per_step", "target_argmax_per_step")}
SERIES["done"] = (RNG.random(STEPS) < 0.3).astype(float)
SERIES["eval_step_index"] = np.arange(BURSTS) * 10.0
MATRIX = {k: RNG.normal(size=(BURSTS, EPISODES)) for k in ("mc_return", "predicted_q_at_start", "episode_length")}


@pytest.fixture(scope="module")
def cells(spark):
    metrics.register()
    row = {k: v.tolist() for k, v in {**SERIES, **MATRIX}.items()} | {"arm_key": "baseline", "gamma": 0.9, "n_actions": 4, "reward_scale": 2.0}
    empty = {k: [] for k in {**SERIES, **MATRIX}} | {"arm_key": None, "gamma": 1.0, "n_actions": 1, "reward_scale": 0.0}
    kinds = ", ".join([*(f"{k} array<double>" for k in SERIES), *(f"{k} array<array<double>>" for k in MATRIX), "arm_key string, gamma double, n_actions int, reward_scale double"])
    return spark.createDataFrame([tuple(row.values()), tuple(empty.values())], kinds)


def entropy(x):
    p = np.unique(x, return_counts=True)[1] / len(x)
    return -(p * np.log(p)).sum()


def test_against_numpy(cells):
    mc, q0 = MATRIX["mc_return"], MATRIX["predicted_q_at_start"]
    m, late = mc.mean(1), {k: v[len(v) // 2 :] for k, v in SERIES.items()}
    gap = SERIES["target_max_q_per_step"] - SERIES["target_q_at_online_argmax_per_step"]
    qb = SERIES["online_max_q_per_step"].reshape(BURSTS, -1).mean(1)
    state, arg = late["state_hash_per_step"], late["online_argmax_per_step"]
    want = {
        "q_late_mean": late["online_max_q_per_step"].mean(),
        "bootstrap_gap_frac_active": (gap > 0.001).mean(),
        "td_residual_late": np.abs(late["td_error"]).mean(),
        "q_autocorr_late": np.corrcoef(late["online_max_q_per_step"][:-1], late["online_max_q_per_step"][1:])[0, 1],
        "state_hash_entropy_late": entropy(state),
        "state_conditional_argmax_entropy_late": entropy(state * 10 + arg) - entropy(state),
        "argmax_persistence_late": (arg[1:] == arg[:-1]).mean(),
        "greedy_match_late": (arg == late["target_argmax_per_step"]).mean(),
        "late_window_mean": SERIES["ep_return"][54:][SERIES["done"][54:] > 0.5].mean() if SERIES["done"][54:].any() else None,
        "eval_best_burst_mean": m.max(),
        "eval_final_mean": m[-1],
        "eval_late_burst_mean": m[-2:].mean(),
        "eval_best_burst_step": float(m.argmax() * 10),
        "learning_curve_auc": np.trapezoid(m) / (BURSTS - 1),
        "plateau_slope_late": np.polyfit(range(2), m[4:], 1)[0],
        "jensen_gap": max(0.0, (q0 - mc).mean()),
        "q_mc_calibration_pearson": np.corrcoef(q0.ravel(), mc.ravel())[0, 1],
        "outcome_episode_sigma": mc.std(1).mean(),
        "q_burst_to_mc_cross_lag1": np.corrcoef(qb[:-1], m[1:])[0, 1],
        "mc_burst_trend": np.corrcoef(np.argsort(np.argsort(m)), range(BURSTS))[0, 1],
        "effective_horizon": 10.0,
    }
    got = panel.with_metrics(cells, list(want)).first()
    for name, value in want.items():
        assert got[name] == (pytest.approx(value) if value is not None else None), name


def test_all_run_on_short_cells(cells):
    names = [n for n in metrics.METRICS if all(r in cells.columns or r in metrics.METRICS for r in metrics.METRICS[n][0]) and "overlap" not in n and "mismatch" not in n and "within_batch" not in n and n != "log_tau"]
    rows = panel.with_metrics(cells, names).select(*names).collect()
    assert len(names) > 70 and len(rows) == 2 and rows[1]["q_late_mean"] is None and rows[1]["effective_horizon"] is None
