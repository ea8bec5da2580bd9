"""Run metrics by name: expressions over a cell's series and (burst, episode) matrices.

Each entry says what it reads and gives a column; ``plans.panel.with_metrics`` adds them in the order of what they read.
Series are arrays over steps; ``mc_return`` and ``predicted_q_at_start`` are arrays of bursts of episodes. Halves and
bursts follow ``arrays``: the late half is x[n // 2:], bursts are cut at floor(n i / bursts). Too short or constant input
gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as a
from .columns import col, number

#: Name to (columns and metrics read, function of no arguments that gives the column).
METRICS: dict[str, tuple[tuple[str, ...], object]] = {}
#: A gap between the two bootstrap targets counts as active above this.
ACTIVE = 0.001


def _add(name: str, reads: tuple[str, ...], make) -> None:
    METRICS[name] = (reads, make)


def s(key: str) -> Column:
    return a.series(key)


def matrix(key: str) -> Column:
    return col(key).cast("array<array<double>>")


def early_half(x: Column) -> Column:
    n = F.size(x)
    return F.when(n >= 2, F.slice(x, 1, F.floor(n / 2).cast("int")))


def combined(x: Column, y: Column, f) -> Column:
    """Elementwise over two series of one length."""
    return F.zip_with(x, y, f)


def bursts() -> Column:
    return F.size(col("eval_step_index"))


def burst_means(key: str = "mc_return") -> Column:
    return a.reduce_axis(matrix(key), "mean")


def q_burst_means(key: str = "online_max_q_per_step") -> Column:
    """The step series cut into as many bursts as there are evaluation bursts."""
    return a.by_burst(s(key), F.size(col("mc_return")))


def pearson(x: Column, y: Column) -> Column:
    mx, my = a.mean(x), a.mean(y)
    cov = a.total(F.zip_with(x, y, lambda u, v: (u - mx) * (v - my)))
    return F.when(F.size(x) >= 2, F.try_divide(cov, F.size(x) * a.std(x) * a.std(y)))


def cross(x: Column, y: Column, lag: int = 1) -> Column:
    """Correlation of x with y ``lag`` later."""
    n = F.greatest(F.size(x) - lag, F.lit(0))
    return pearson(F.slice(x, 1, n), F.slice(y, lag + 1, n))


def ranks(x: Column) -> Column:
    return F.transform(x, lambda v: a.total(F.transform(x, lambda u: F.when(u < v, 1.0).when(u == v, 0.5).otherwise(0.0))) + 0.5)


def trend(x: Column) -> Column:
    """Rank correlation of a series with its index; null under four elements."""
    return F.when(F.size(x) >= 4, pearson(ranks(x), F.transform(x, lambda v, i: i + F.lit(1.0))))


def mode_share(x: Column) -> Column:
    most = F.array_max(F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda u: u == v))))
    return F.try_divide(most.cast("double"), F.size(x).cast("double"))


def repeats(x: Column) -> Column:
    """Share of neighbours that are equal."""
    n = F.size(x)
    same = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(x, i) == F.get(x, i - 1))
    return F.when(n >= 2, F.try_divide(F.size(same).cast("double"), (n - 1).cast("double")))


def conditional_entropy(x: Column, given: Column) -> Column:
    """H(x, given) - H(given), in nats."""
    both = F.zip_with(x, given, lambda u, v: F.concat_ws("|", u.cast("string"), v.cast("string")))
    return a.entropy(both) - a.entropy(given.cast("array<string>"))


def log_bias(n_actions: Column) -> Column:
    return F.sqrt(2 * F.ln(F.greatest(n_actions.cast("double"), F.lit(2.0))) / F.lit(math.pi))


# plain late halves and bursts of one series: metric name, series
for _name, _key in (
    ("q_late_mean", "online_max_q_per_step"), ("q_action_std_late", "online_std_q_per_step"), ("q_argmax_margin_late", "online_top12_margin_per_step"),
    ("q_action_grad_overlap_late", "q_action_grad_overlap_per_step"), ("bootstrap_action_mismatch_late", "bootstrap_action_mismatch_per_step"),
    ("q_inter_state_grad_overlap_late", "q_inter_state_grad_overlap_per_step"), ("q_inter_state_grad_overlap_random_late", "q_inter_state_grad_overlap_random_per_step"),
    ("td_within_batch_var_late", "td_error_within_batch_std"),
):
    _add(_name, (_key,), lambda k=_key: a.mean(a.late_half(s(k))))
for _name, _key in (("q_per_burst", "online_max_q_per_step"), ("q_action_std_per_burst", "online_std_q_per_step"), ("q_argmax_margin_per_burst", "online_top12_margin_per_step")):
    _add(_name, (_key, "eval_step_index"), lambda k=_key: a.by_burst(s(k), bursts()))

# differences and ratios of two series
_MAX, _MIN, _STD, _MEAN, _ARG = (f"online_{x}_per_step" for x in ("max_q", "min_q", "std_q", "mean_q", "argmax"))
_TARGET, _AT = "target_max_q_per_step", "target_q_at_online_argmax_per_step"
_gap = lambda: combined(s(_TARGET), s(_AT), lambda t, o: t - o)
_range = lambda: combined(s(_MAX), s(_MIN), lambda u, v: u - v)
_stale = lambda: combined(s(_MAX), s(_TARGET), lambda u, v: F.try_divide(F.abs(u - v), F.greatest(F.abs(u), F.lit(1e-9))))
_match = lambda: combined(s(_ARG), s("target_argmax_per_step"), lambda u, v: (u == v).cast("double"))
_active = lambda: F.transform(_gap(), lambda g: (g > ACTIVE).cast("double"))
_add("q_gap_late", (_MAX, _MIN), lambda: a.mean(a.late_half(_range())))
_add("q_gap_growth", (_MAX, _MIN), lambda: a.mean(a.late_half(_range())) - a.mean(early_half(_range())))
_add("ddqn_bootstrap_gap", (_TARGET, _AT), lambda: a.mean(_gap()))
_add("bootstrap_gap_magnitude", (_TARGET, _AT), lambda: a.mean(_gap()))
_add("bootstrap_gap_frac_active", (_TARGET, _AT), lambda: a.mean(_active()))
_add("ddqn_bootstrap_gap_late", (_TARGET, _AT), lambda: a.mean(a.late_half(_gap())))
_add("bootstrap_gap_magnitude_per_burst", (_TARGET, _AT, "eval_step_index"), lambda: a.by_burst(_gap(), bursts()))
_add("bootstrap_disagree_rate_per_burst", (_TARGET, _AT, "eval_step_index"), lambda: a.by_burst(_active(), bursts()))
_add("bootstrap_disagree_gap_conditional_per_burst", (_TARGET, _AT, "eval_step_index"), lambda: a.by_burst(_gap(), bursts(), lambda x: a.mean(F.filter(x, lambda g: g > ACTIVE))))
_add("target_staleness_late", (_MAX, _TARGET), lambda: a.mean(a.late_half(_stale())))
_add("target_staleness_early", (_MAX, _TARGET), lambda: a.mean_window(_stale(), 0.0, 0.25))
_add("v_vs_max_delta_late", (_MEAN, _MAX), lambda: a.mean(a.late_half(combined(s(_MEAN), s(_MAX), lambda u, v: F.abs(u - v)))))
_add("td_residual_late", ("td_error",), lambda: a.mean(a.late_half(F.transform(s("td_error"), F.abs))))
_add("q_range_to_std_late", (_MAX, _MIN, _STD), lambda: a.mean(F.filter(a.late_half(F.zip_with(_range(), s(_STD), lambda r, d: F.when(d > 1e-9, r / d))), lambda v: v.isNotNull())))
_add("q_max_growth", (_MAX,), lambda: a.growth_window(s(_MAX)))
_add("q_max_temporal_cv_late", (_MAX,), lambda: a.cv_safe(a.late_half(s(_MAX))))
_add("q_autocorr_late", (_MAX,), lambda: a.autocorrelation(a.late_half(s(_MAX)), 1))
_add("q_autocorr_per_burst", (_MAX, "eval_step_index"), lambda: a.by_burst(s(_MAX), bursts(), lambda x: a.autocorrelation(x, 1)))
_add("greedy_match_late", (_ARG, "target_argmax_per_step"), lambda: a.mean(a.late_half(_match())))
_add("greedy_match_per_burst", (_ARG, "target_argmax_per_step", "eval_step_index"), lambda: a.by_burst(_match(), bursts()))
_add("q_inter_state_grad_overlap_excess_late", ("q_inter_state_grad_overlap_late", "q_inter_state_grad_overlap_random_late"), lambda: col("q_inter_state_grad_overlap_late") - col("q_inter_state_grad_overlap_random_late"))
_add("q_action_gap_relative_late", ("online_top12_margin_per_step", _MAX), lambda: F.try_divide(a.mean(a.late_half(s("online_top12_margin_per_step"))), F.abs(a.mean(a.late_half(s(_MAX))))))
_add("q_signal_to_noise_late", ("q_late_mean", "q_action_std_late"), lambda: F.try_divide(F.abs(col("q_late_mean")), col("q_action_std_late")))

# visited states and greedy actions
_STATE = "state_hash_per_step"
for _part, _cut in (("late", a.late_half), ("early", early_half)):
    _add(f"state_hash_entropy_{_part}", (_STATE,), lambda c=_cut: a.entropy(c(col(_STATE))))
    _add(f"state_hash_n_unique_{_part}", (_STATE,), lambda c=_cut: a.distinct(c(col(_STATE))).cast("double"))
_add("unique_states_visited_late", (_STATE,), lambda: a.distinct(a.late_half(col(_STATE))).cast("double"))
_add("state_visit_entropy_late", (_STATE,), lambda: a.entropy(a.late_half(col(_STATE))))
_add("state_coverage_kl_uniform_late", (_STATE,), lambda: F.ln(a.distinct(a.late_half(col(_STATE))).cast("double")) - a.entropy(a.late_half(col(_STATE))))
_add("state_repeat_rate_window64_late", (_STATE,), lambda: a.repeat_rate(a.late_half(col(_STATE)), 64))
_add("state_repeat_rate_window256_late", (_STATE,), lambda: a.repeat_rate(a.late_half(col(_STATE)), 256))
_add("argmax_entropy_late", (_ARG,), lambda: a.entropy(a.late_half(col(_ARG))))
_add("argmax_entropy_per_burst", (_ARG, "eval_step_index"), lambda: a.by_burst(col(_ARG), bursts(), a.entropy))
_add("argmax_mode_freq_late", (_ARG,), lambda: mode_share(a.late_half(col(_ARG))))
_add("argmax_persistence_late", (_ARG,), lambda: repeats(a.late_half(col(_ARG))))
_add("state_conditional_argmax_entropy_late", (_ARG, _STATE), lambda: conditional_entropy(a.late_half(col(_ARG)), a.late_half(col(_STATE))))
_add("mutual_info_state_argmax_late", (_ARG, _STATE), lambda: a.entropy(a.late_half(col(_ARG))) - conditional_entropy(a.late_half(col(_ARG)), a.late_half(col(_STATE))))
_add("episode_count_late", ("done",), lambda: a.total(a.late_half(s("done"))))
_add("mean_episode_length_late", ("done",), lambda: F.try_divide(F.size(a.late_half(s("done"))).cast("double"), a.total(a.late_half(s("done")))))
_add("train_episode_length_mean", ("done",), lambda: F.try_divide(F.size(s("done")).cast("double"), a.total(s("done"))))
_add("late_window_mean", ("ep_return", "done"), lambda: a.masked_mean(a.window(s("ep_return"), 0.9, 1.0), a.window(s("done"), 0.9, 1.0)))

# returns by burst and episode
_MC, _Q0 = "mc_return", "predicted_q_at_start"
_bias = lambda: F.zip_with(matrix(_Q0), matrix(_MC), lambda q, m: F.zip_with(q, m, lambda u, v: u - v))
_flat = lambda k: F.flatten(matrix(k))
_add("mc_return_per_burst_mean", (_MC,), burst_means)
_add("mc_return_per_burst_std", (_MC,), lambda: a.reduce_axis(matrix(_MC), "std"))
_add("mc_variance_per_burst", (_MC,), lambda: a.reduce_axis(matrix(_MC), "var"))
_add("log_mc_variance_per_burst", (_MC,), lambda: F.transform(a.reduce_axis(matrix(_MC), "var"), a.log_safe))
_add("mc_cv_per_burst", (_MC,), lambda: F.transform(matrix(_MC), a.cv_safe))
_add("log_mc_cv_per_burst", (_MC,), lambda: F.transform(F.transform(matrix(_MC), a.cv_safe), a.log_safe))
_add("mc_return_episode_cv_per_burst", (_MC,), lambda: F.transform(matrix(_MC), a.cv_safe))
_add("mc_return_first_quarter", (_MC,), lambda: a.mean_window(burst_means(), 0.0, 0.25))
_add("mc_return_last_quarter", (_MC,), lambda: a.mean_window(burst_means(), 0.75, 1.0))
_add("eval_final_mean", (_MC,), lambda: F.try_element_at(burst_means(), F.lit(-1)))
_add("eval_best_burst_mean", (_MC,), lambda: F.array_max(burst_means()))
_add("eval_full_auc_mean", (_MC,), lambda: a.mean(_flat(_MC)))
_add("eval_late_burst_mean", (_MC,), lambda: a.mean(F.slice(burst_means(), -F.greatest(F.ceil(F.size(col(_MC)) * 0.3).cast("int"), F.lit(1)), F.greatest(F.ceil(F.size(col(_MC)) * 0.3).cast("int"), F.lit(1)))))
_add("eval_best_burst_step", (_MC, "eval_step_index"), lambda: a.select_at(s("eval_step_index"), burst_means()))
_add("learning_curve_auc", (_MC,), lambda: a.auc(burst_means()))
_add("time_to_threshold", (_MC,), lambda: F.when(F.array_max(burst_means()) > 0, F.coalesce(a.time_to(burst_means()), F.lit(1.0))))
_add("return_at_25pct_steps", (_MC,), lambda: F.get(burst_means(), F.floor(F.size(col(_MC)) * 0.25).cast("int")))
_add("plateau_slope_late", (_MC,), lambda: a.plateau_slope(burst_means()))
_add("mc_growth_max_minus_initial", (_MC,), lambda: F.array_max(burst_means()) - F.get(burst_means(), F.lit(0)))
_add("mc_burst_trend", (_MC,), lambda: trend(burst_means()))
_add("outcome_episode_sigma", (_MC,), lambda: a.mean(a.reduce_axis(matrix(_MC), "std")))
_add("outcome_episode_cv", (_MC, "outcome_episode_sigma"), lambda: F.try_divide(col("outcome_episode_sigma"), F.abs(a.mean(_flat(_MC)))))
_add("outcome_late_to_best_ratio", ("mc_return_last_quarter", "eval_best_burst_mean"), lambda: F.try_divide(col("mc_return_last_quarter"), col("eval_best_burst_mean")))
_add("outcome_native", ("eval_best_burst_mean", "reward_scale"), lambda: F.try_divide(col("eval_best_burst_mean"), number("reward_scale")))
_add("jensen_bias_per_eps", (_Q0, _MC), _bias)
_add("jensen_bias_per_burst_mean", (_Q0, _MC), lambda: F.transform(_bias(), a.mean))
_add("jensen_gap", (_Q0, _MC), lambda: F.greatest(F.lit(0.0), a.mean(F.flatten(_bias()))))
_add("bias_std_across_states", (_Q0, _MC), lambda: a.std(F.flatten(_bias())))
_add("q_mc_calibration_pearson", (_Q0, _MC), lambda: pearson(_flat(_Q0), _flat(_MC)))
_add("env_reward_polarity", ("episode_length", _MC), lambda: pearson(_flat("episode_length"), _flat(_MC)))
_add("clip_wedge_polarity_aligned", ("ddqn_bootstrap_gap", "env_reward_polarity"), lambda: col("ddqn_bootstrap_gap") * F.signum(col("env_reward_polarity")))

# value curve by burst against returns
_add("q_burst_autocorr_lag1", (_MAX, _MC), lambda: a.autocorrelation(q_burst_means(), 1))
_add("q_burst_autoregression_lag1", (_MAX, _MC), lambda: a.autocorrelation(q_burst_means(), 1))
_add("q_burst_to_mc_cross_lag1", (_MAX, _MC), lambda: cross(q_burst_means(), burst_means()))
_add("mc_burst_to_q_cross_lag1", (_MAX, _MC), lambda: cross(burst_means(), q_burst_means()))
_add("q_mc_burst_correlation_late", (_MAX, _MC), lambda: pearson(a.late_half(q_burst_means()), a.late_half(burst_means())))
_add("q_growth_max_minus_initial", (_MAX, _MC), lambda: F.array_max(q_burst_means()) - F.get(q_burst_means(), F.lit(0)))
_add("policy_growth_fraction", ("mc_growth_max_minus_initial", "q_growth_max_minus_initial"), lambda: F.try_divide(col("mc_growth_max_minus_initial"), col("mc_growth_max_minus_initial") + col("q_growth_max_minus_initial")))
_add("td_burst_trend", ("td_error", _MC), lambda: trend(a.by_burst(F.transform(s("td_error"), F.abs), F.size(col(_MC)))))

# arithmetic on columns
_add("arm_is_baseline", ("arm_key",), lambda: (col("arm_key") == "baseline").cast("double"))
_add("effective_horizon", ("gamma",), lambda: F.try_divide(F.lit(1.0), 1 - number("gamma")))
_add("per_step_max_bias", ("jensen_gap", "effective_horizon"), lambda: F.try_divide(col("jensen_gap"), col("effective_horizon")))
_add("hasselt_implied_per_step_bias", ("n_actions", "q_action_std_late"), lambda: log_bias(number("n_actions")) * col("q_action_std_late"))
_add("sigma_over_jens_late", ("q_action_std_late", "jensen_gap"), lambda: F.try_divide(col("q_action_std_late"), col("jensen_gap")))
_add("log_action_dim", ("n_actions",), lambda: F.ln(F.greatest(number("n_actions"), F.lit(2.0))))
_add("log_tau", ("target_sync.tau",), lambda: F.when(number("target_sync.tau") > 0, F.log10(number("target_sync.tau"))))


def register() -> None:
    """Put all of them into the panel's registry."""
    from ..plans import panel

    for name, (reads, make) in METRICS.items():
        panel.METRICS.setdefault(name, panel.Metric(name, reads, make))
