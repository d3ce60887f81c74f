"""Queries of the battery, vehicle and heat-pump packs."""

from __future__ import annotations

from meterloom import fixtures as fx
from meterloom.operators.days import house_days
from meterloom.plans import bat20 as bat
from meterloom.plans import ev20 as ev
from meterloom.plans import hp21 as hp
from meterloom.queries.base import DAY, MID, NZ, SUMMER, WINTER, clip, cols, query, rat

PEAK, CHARGE = "(k >= 68 AND k < 84)", "(k >= 92 OR k < 24)"
_F = lambda f, w: f"coalesce({f} FILTER ({w}), 0)"
_Z = lambda x, v="0": f"coalesce({x}, {v})"

BAT_DAYS = f"""q AS (SELECT *, coalesce(kw, 0) AS v, coalesce(kw > 0.05, false) AS act, coalesce(kw > 0.5 AND {CHARGE}, false) AS chg, max(kw) OVER (PARTITION BY mp_id, channel, date) AS top FROM s),
q2 AS (SELECT *, lag(act) OVER w AS pact, lag(chg) OVER w AS pchg, lag(v) OVER w AS pv FROM q WINDOW w AS (PARTITION BY mp_id, channel, date ORDER BY k)),
d0 AS (SELECT mp_id, channel, date, sum(neg) AS n_neg, coalesce(max(rmax), -1.0) AS vmax_raw, sum(v) AS tot, {_F('sum(kw)', MID)} AS mid_tot, {_F('sum(kw)', PEAK)} AS peak_tot, {_F('sum(kw)', NZ)} AS night_tot, {_F('sum(kw)', CHARGE)} AS charge_sum, {_F('sum(kw * kw)', CHARGE)} AS charge_sq,
  count(kw) AS n_valid, count(kw) FILTER ({MID}) AS n_mid, count(kw) FILTER ({PEAK}) AS n_peak, count(kw) FILTER ({NZ}) AS n_night, count(kw) FILTER ({DAY}) AS n_day, count(kw) FILTER ({CHARGE}) AS n_charge, max(kw) AS vmax,
  count(*) FILTER ({NZ} AND kw <= 0.02) AS zero_night, count(*) FILTER ({DAY} AND kw <= 0.02) AS zero_day, count(*) FILTER (act AND NOT coalesce(pact, false)) AS bursts, count(*) FILTER (chg AND NOT coalesce(pchg, false)) AS cbursts,
  count(*) FILTER (abs(v - pv) > 0.3 AND ((k BETWEEN 1 AND 23) OR k >= 89)) AS ramps, {rat('count(*) FILTER (act AND kw >= 0.9 * top)::DOUBLE', 'count(*) FILTER (act)')} AS plateau FROM q2 GROUP BY ALL),
d1 AS (SELECT *, channel = 'import' AS i, channel = 'export' AS e, {SUMMER} AS s0, {WINTER} AS w0 FROM d0),
d AS (SELECT *, s0 OR NOT bool_or(s0) OVER c AS s, w0 OR NOT bool_or(w0) OVER c AS w, coalesce(sum(tot) FILTER (i) OVER h / greatest(sum(n_valid) FILTER (i) OVER h, 1), 0) AS mi, charge_sum / greatest(n_charge, 1) AS charge,
  CASE WHEN i THEN max(mid_tot) FILTER (e) OVER (PARTITION BY mp_id, date) END AS x FROM d1 WINDOW c AS (PARTITION BY mp_id, channel), h AS (PARTITION BY mp_id)),
d2 AS (SELECT *, sqrt(greatest(charge_sq / greatest(n_charge, 1) - charge * charge, 0)) / {clip('charge')} AS cv FROM d)"""
_OKC, _OKP, _OKM = "i AND n_charge >= 25.2", "i AND n_peak >= 14.4 AND n_valid - n_peak > 0", "i AND n_mid >= 14.4 AND n_night >= 28.8"
BAT = f"""g AS (SELECT mp_id, count(*) FILTER (i) AS n_days, count(*) FILTER (i AND s0) AS ns, count(*) FILTER (i AND w0) AS nw, max(CASE WHEN e THEN 1 ELSE 0 END) AS has_e, coalesce(max(vmax_raw) FILTER (e), 0) AS raw, sum(n_neg) AS neg, max(mi) AS mi,
  {_F('sum(tot)', 'i')} AS i, {_F('sum(tot)', 'i AND s')} / greatest(count(*) FILTER (i AND s), 1) AS ips, {_F('sum(tot)', 'i AND w')} / greatest(count(*) FILTER (i AND w), 1) AS ipw, {_F('sum(tot)', 'e')} AS e, {_F('sum(tot)', 'e AND s')} / greatest(count(*) FILTER (i AND s), 1) / 4 AS eps_, {_F('sum(tot)', 'e AND w')} / greatest(count(*) FILTER (i AND w), 1) / 4 AS epw,
  count(*) FILTER (e AND tot / 4 > 0.1) AS ed, {_F('sum(night_tot)', 'e')} AS en, count(*) FILTER (e AND night_tot / 4 > 0.02) AS eo, {_F('avg(plateau)', 'e')} AS plateau, {_F('avg(bursts)', 'e')} AS bursts, {_F('quantile_cont(vmax, 0.95)', 'e')} AS emax,
  {_F('avg(zero_night)', 'i AND n_night >= 28.8')} AS zn, {_F('quantile_cont(charge, 0.95)', _OKC)} AS c95, coalesce(avg(cv) FILTER ({_OKC}), 1) AS cv, {_F('avg(CASE WHEN charge > 1.5 * mi THEN 1.0 ELSE 0 END)', _OKC)} AS above,
  {_F(f"avg(1 - (peak_tot / greatest(n_peak, 1)) / {clip('(tot - peak_tot) / greatest(n_valid - n_peak, 1)')})", _OKP)} AS sup, {_F('avg(ramps)', 'i')} AS ramps, {_F('avg(zero_day)', 'i AND n_day >= 28.8')} AS zd, {_F('avg(mid_tot / greatest(n_mid, 1))', _OKM)} AS mid, {_F('avg(night_tot / greatest(n_night, 1))', _OKM)} AS night, {_F('avg(cbursts)', 'i')} AS cb,
  CASE WHEN count(*) FILTER (i AND x IS NOT NULL) >= 10 AND stddev_pop(x) FILTER (i) > 1e-9 AND stddev_pop(peak_tot) FILTER (i AND x IS NOT NULL) > 1e-9 THEN (covar_pop(x, peak_tot) FILTER (i)) / (stddev_pop(x) FILTER (i) * stddev_pop(peak_tot) FILTER (i AND x IS NOT NULL)) END AS sh FROM d2 GROUP BY mp_id HAVING count(*) FILTER (i) > 0)"""
_FLAT = lambda a, b: f"-abs(ln(({a} + 0.02) / ({b} + 0.02)))"
_BAT = {
    "export_kwh_total": "e / 4", "export_days_frac": "ed::DOUBLE / n_days", "export_offsolar_over_import": f"en / {clip('i')}", "export_offsolar_days_frac": "eo::DOUBLE / n_days", "export_flat_plateau_frac": "plateau", "export_bursts_per_day": "bursts", "export_max_kw": "emax",
    "export_max_over_mean_import": f"emax / {clip('mi')}", "export_summer_winter_flatness": _FLAT("eps_", "epw"), "import_zero_hours_night": "zn / 4", "import_night_charge_kw_over_mean": f"c95 / {clip('mi')}", "import_night_charge_flatness": "cv", "import_night_charge_persistence": "above",
    "import_evening_peak_suppression": "sup", "import_ramp_events_night": "ramps", "import_zero_hours_midday_allyear": "zd / 4", "import_seasonal_flatness": _FLAT("ips", "ipw"), "import_midday_night_ratio_allyear": f"mid / {clip('night')}", "daily_activity_cycles": "bursts + cb", "self_consumption_shift_score": "coalesce(-sh, 0)",
    "export_max_raw_kw": "raw", "mean_import_kw": "mi",
}
_BATL = {"n_days": "n_days", "n_summer_days": "ns", "n_winter_days": "nw", "has_export_register": "has_e", "has_real_export": "emax >= 0.1", "n_negative_raw": "neg", "has_offsolar_export": "eo::DOUBLE / n_days > 0.02"}


def _bat(source):
    return f"WITH {source}, {BAT_DAYS}, {BAT} SELECT {cols(_BAT, _BATL, 'mp_id')} FROM g"


@query("f5_bat20", _bat(fx.METER_SQL))
def bat20(spark, d):
    return bat.bat20(house_days(fx.meter_days(spark, d), dealt=True))


@query("f5_bat20_sparse", _bat(fx.SPARSE_SQL))
def bat20_sparse(spark, d):
    return bat.bat20(house_days(fx.sparse_meter_days(spark, d)))


#: Noon windows (k from noon), then their reduction.
EV_DAYS = """nx AS (SELECT a.mp_id, a.date, CASE WHEN a.k >= 48 THEN a.k - 48 ELSE a.k + 48 END AS k, CASE WHEN a.k >= 48 THEN a.kw ELSE b.kw END AS kw FROM s a LEFT JOIN s b ON a.k < 48 AND b.channel = 'import' AND b.mp_id = a.mp_id AND b.date = a.date + 1 AND b.k = a.k WHERE a.channel = 'import'),
wb AS (SELECT *, coalesce(quantile_cont(kw, 0.1) OVER (PARTITION BY mp_id, date), 0) AS base FROM nx),
wa AS (SELECT *, coalesce(kw - base, 0) AS above, coalesce(kw - base >= 2.0, false) AS high, coalesce(kw, 0) - lag(coalesce(kw, 0)) OVER (PARTITION BY mp_id, date ORDER BY k) AS step FROM wb),
wr AS (SELECT *, k - row_number() OVER (PARTITION BY mp_id, date, high ORDER BY k) AS run FROM wa),
rl AS (SELECT mp_id, date, run, min(k) AS start, count(*) AS n FROM wr WHERE high GROUP BY ALL),
lr AS (SELECT mp_id, date, count(*) FILTER (n >= 4) AS n_runs, max(n) AS len, min(start) FILTER (n = (SELECT max(n) FROM rl r2 WHERE r2.mp_id = rl.mp_id AND r2.date = rl.date)) AS start FROM rl GROUP BY ALL),
blk AS (SELECT a.mp_id, a.date, median(above) AS lvl, sum(above) / 4 AS en FROM wa a JOIN lr USING (mp_id, date) WHERE a.k >= lr.start AND a.k < lr.start + lr.len GROUP BY ALL),
fl AS (SELECT a.mp_id, a.date, avg(CASE WHEN abs(above - lvl) <= 0.1 * greatest(lvl, 1e-6) THEN 1.0 ELSE 0 END) AS share FROM wa a JOIN lr USING (mp_id, date) JOIN blk USING (mp_id, date) WHERE a.k >= lr.start AND a.k < lr.start + CASE WHEN lr.len >= 8 THEN lr.len - 3 ELSE lr.len END GROUP BY ALL),
wd AS (SELECT mp_id, date, count(kw) AS n_valid, coalesce(sum(kw), 0) AS tot, max(base) AS base, max(above) AS vmax_over_base, count(*) FILTER (high) / 4.0 AS hours_high, coalesce(sum(above) FILTER (high), 0) / 4 AS e_high, max(step) AS step_up FROM wa GROUP BY ALL),
ed AS (SELECT wd.*, coalesce(n_runs, 0) AS n_runs, coalesce(len, 0) AS blk_len, coalesce(lvl, 0) AS blk_level, coalesce(en, 0) AS blk_energy, coalesce(share, 0) AS blk_flat_share, (((start + 48) % 96) + 0.5) / 4 AS blk_start_h, coalesce(len, 0) >= 4 AS p FROM wd LEFT JOIN lr USING (mp_id, date) LEFT JOIN blk USING (mp_id, date) LEFT JOIN fl USING (mp_id, date))"""
_P = lambda f: f"coalesce({f} FILTER (p), 0)"
_PA = "avg(CASE WHEN p THEN 1.0 ELSE 0 END)"
EV = f"""e2 AS (SELECT *, median(CASE WHEN p THEN blk_level END) OVER (PARTITION BY mp_id) AS level, lag(date) OVER (PARTITION BY mp_id, p ORDER BY date) AS prior, {SUMMER} AS s0, {WINTER} AS w0, isodow(date) >= 6 AS we FROM ed),
g AS (SELECT mp_id, count(*) AS n, count(*) FILTER (p) AS np, {_P('median(blk_level)')} AS lvl, {_P('quantile_cont(blk_level, 0.9)')} AS lvl9, {_P('avg(CASE WHEN abs(blk_level - level) <= 0.15 * level THEN 1.0 ELSE 0 END)')} AS same, {_P('median(blk_len)')} AS len, {_P('quantile_cont(blk_len::DOUBLE, 0.9)')} AS len9,
  {_P('median(blk_energy)')} AS en, {_P('quantile_cont(blk_energy, 0.9)')} AS en9, count(*) FILTER (p AND blk_flat_share >= 0.8) AS flat, {_P('median(step_up)')} AS step, {_P('avg(CASE WHEN blk_start_h >= 17 OR blk_start_h < 7 THEN 1.0 ELSE 0 END)')} AS eve,
  coalesce(sqrt(-2 * ln(least(greatest(sqrt(pow(avg(cos(blk_start_h * 2 * pi() / 24)) FILTER (p), 2) + pow(avg(sin(blk_start_h * 2 * pi() / 24)) FILTER (p), 2)), 1e-12), 1.0))) * 24 / (2 * pi()), 0) AS spread, count(*) FILTER (p AND blk_start_h >= 7 AND blk_start_h < 17) AS dayp,
  coalesce({_PA} FILTER (we), 0) - coalesce({_PA} FILTER (NOT we), 0) AS wewd, coalesce(median(date_diff('day', prior, date)) FILTER (p AND prior IS NOT NULL), date_diff('day', min(date), max(date)) + 1) AS gap, coalesce({_PA} FILTER (w0), {_PA}) - coalesce({_PA} FILTER (s0), {_PA}) AS ws,
  quantile_cont(vmax_over_base, 0.99) AS mx, avg(hours_high) AS hh, sum(e_high) AS eh, sum(tot) AS tot, {_P('avg(n_runs)')} AS runs, count(*) FILTER (s0) AS ns, count(*) FILTER (w0) AS nw, sum(n_valid) AS nv, median(base) AS base FROM e2 GROUP BY mp_id)"""
_EV = {
    "ev_plateau_days_frac": "np::DOUBLE / n", "ev_plateau_level_kw": "lvl", "ev_plateau_level_p90_kw": "lvl9", "ev_level_consistency": "same", "ev_plateau_duration_h": "len / 4", "ev_plateau_duration_p90_h": "len9 / 4", "ev_plateau_energy_kwh": "en", "ev_plateau_energy_p90_kwh": "en9",
    "ev_flat_plateau_days_frac": "flat::DOUBLE / n", "ev_step_up_kw": "step", "ev_start_evening_night_frac": "eve", "ev_start_hour_spread_h": "spread", "ev_day_plateau_days_frac": "dayp::DOUBLE / n", "ev_weekend_minus_weekday_frac": "wewd", "ev_gap_days_median": "gap", "ev_plateau_days_winter_minus_summer": "ws",
    "ev_max_over_base_kw": "mx", "ev_high_hours_per_day": "hh", "ev_high_energy_share": f"eh / {clip('tot / 4')}", "ev_sessions_per_plateau_day": "runs", "mean_import_kw": "tot / greatest(nv, 1)", "base_kw": "base",
}
_EVL = {"n_days": "n", "n_summer_days": "ns", "n_winter_days": "nw"}


@query("f6_ev20", f"WITH {fx.METER_SQL}, {EV_DAYS}, {EV} SELECT {cols(_EV, _EVL, 'mp_id')} FROM g")
def ev20(spark, d):
    return ev.ev20(house_days(fx.meter_days(spark, d), dealt=True))


HP_DAYS = f"""hb AS (SELECT *, coalesce(quantile_cont(kw, 0.1) OVER (PARTITION BY mp_id, date), 0) AS base, coalesce(quantile_cont(kw, 0.99) OVER (PARTITION BY mp_id, date), 0) AS vp99 FROM s WHERE channel = 'import'),
hr AS (SELECT *, coalesce(kw - base >= 0.5, false) AS run FROM hb),
hn AS (SELECT *, lag(run) OVER w AS prun, lag(kw) OVER w AS pkw, k - row_number() OVER (PARTITION BY mp_id, date, run ORDER BY k) AS rid FROM hr WINDOW w AS (PARTITION BY mp_id, date ORDER BY k)),
hc AS (SELECT mp_id, date, count(*) FILTER (n >= 2) AS n_cycles FROM (SELECT mp_id, date, rid, count(*) AS n FROM hn WHERE run GROUP BY ALL) GROUP BY ALL),
h0 AS (SELECT mp_id, date, count(kw) AS n_valid, coalesce(sum(kw), 0) AS tot, coalesce(sum(kw) FILTER (k >= 8 AND k < 24), 0) AS early, max(base) AS base, coalesce(max(kw), 0) AS vmax, max(vp99) AS vp99, count(*) FILTER (run) / 4.0 AS run_hours, coalesce(avg(kw - base) FILTER (run), 0) AS run_level,
  coalesce(avg(abs(kw - pkw)) FILTER (run AND prun), 0) AS run_jump FROM hn GROUP BY ALL),
h1 AS (SELECT h0.*, coalesce(n_cycles, 0) AS n_cycles, tot / 4 AS kwh, month(date) AS mon, {SUMMER} AS s0, {WINTER} AS w0 FROM h0 LEFT JOIN hc USING (mp_id, date)),
h2 AS (SELECT *, s0 OR NOT bool_or(s0) OVER m AS s, w0 OR NOT bool_or(w0) OVER m AS w, avg(kwh) OVER (PARTITION BY mp_id, mon) AS mm, row_number() OVER (PARTITION BY mp_id, mon ORDER BY date) = 1 AS fm FROM h1 WINDOW m AS (PARTITION BY mp_id)),
h3 AS (SELECT *, kwh - mm AS an, CASE WHEN w AND date_diff('day', lag(date) OVER o, date) = 1 THEN lag(kwh - mm) OVER o END AS pr FROM h2 WINDOW o AS (PARTITION BY mp_id, w ORDER BY date)),
h4 AS (SELECT h3.*, CASE WHEN n_valid >= 86.4 AND temp_c < 15 THEN temp_c END AS t FROM h3 LEFT JOIN (SELECT date, temp_c FROM w WHERE n = 1) tw USING (date))"""
_W = lambda f, t="w": f"coalesce({f} FILTER ({t}), 0)"
HP = f"""g AS (SELECT mp_id, count(*) AS n, count(*) FILTER (s0) AS ns, count(*) FILTER (w0) AS nw, {_W('avg(kwh)')} AS ew, {_W('avg(kwh)', 's')} AS es, {_W('median(base)')} AS bw, {_W('median(base)', 's')} AS bs, max(mm) AS mx, min(mm) AS mn, avg(mm) FILTER (fm) AS ma, {_W('quantile_cont(kwh, 0.9)')} - {_W('quantile_cont(kwh, 0.1)')} AS kd, {_W('median(kwh)')} AS k5,
  {_W('avg(run_hours)')} AS rw, {_W('avg(run_hours)', 's')} AS rs, {_W('avg(n_cycles)')} AS cw, {_W('avg(n_cycles)', 's')} AS cs, {_W('sum(run_hours)')} AS rsum, {_W('sum(n_cycles)')} AS csum, {_W('avg(run_level)')} AS lw, {_W('quantile_cont(run_level, 0.9)')} - {_W('quantile_cont(run_level, 0.1)')} AS ld, {_W('median(run_level)')} AS l5, {_W('avg(run_jump)')} AS j,
  {_W(f"avg(tot / 96 / {clip('vmax')})")} AS lfw, {_W(f"avg(tot / 96 / {clip('vmax')})", 's')} AS lfs, {_W(f"avg(early / {clip('tot')})")} AS emw, {_W(f"avg(early / {clip('tot')})", 's')} AS ems, {_W('quantile_cont(vp99, 0.9)')} - {_W('quantile_cont(vp99, 0.9)', 's')} AS pk,
  CASE WHEN count(pr) >= 5 AND stddev_pop(pr) > 1e-9 AND stddev_pop(an) FILTER (pr IS NOT NULL) > 1e-9 THEN covar_pop(pr, an) / (stddev_pop(pr) * stddev_pop(an) FILTER (pr IS NOT NULL)) END AS l1, count(t) AS nc, CASE WHEN count(t) >= 5 AND var_pop(t) > 0.25 THEN covar_pop(t, kwh) / var_pop(t) END AS b,
  sum(tot) AS tot, sum(n_valid) AS nv, median(base) AS base FROM h4 GROUP BY mp_id)"""
_HP = {
    "hp_winter_summer_energy_ratio": f"ew / {clip('es')}", "hp_base_winter_minus_summer_kw": "bw - bs", "hp_base_winter_over_summer": f"bw / {clip('bs')}", "hp_monthly_energy_amplitude": f"(mx - mn) / {clip('ma')}", "hp_daily_energy_winter_kwh": "ew", "hp_daily_energy_spread_winter": f"least(kd / {clip('k5')}, 10)",
    "hp_run_hours_winter": "rw", "hp_run_hours_winter_minus_summer": "rw - rs", "hp_cycles_per_day_winter": "cw", "hp_cycle_length_h_winter": "rsum / greatest(csum, 1)", "hp_cycles_per_day_summer": "cs", "hp_level_winter_kw": "lw", "hp_level_spread_winter": "least(ld / greatest(l5, 0.5), 10)",
    "hp_modulation_index_winter": f"j / {clip('lw')}", "hp_load_factor_winter": "lfw", "hp_load_factor_winter_minus_summer": "lfw - lfs", "hp_early_morning_share_winter": "emw", "hp_early_morning_share_winter_minus_summer": "emw - ems", "hp_peak_winter_minus_summer_kw": "pk",
    "hp_daily_energy_persistence_winter": "least(greatest(coalesce(l1, 0), -1), 1)", "hp_energy_cold_slope_kwh_per_degc": "coalesce(-b, 0)", "mean_import_kw": "tot / greatest(nv, 1)", "base_kw": "base",
}


@query("f7_hp21", f"WITH {fx.METER_SQL}, {fx.WEATHER_SQL}, {HP_DAYS}, {HP} SELECT {cols(_HP, {'n_days': 'n', 'n_summer_days': 'ns', 'n_winter_days': 'nw', 'n_cold_days': 'nc'}, 'mp_id')} FROM g")
def hp21(spark, d):
    return hp.hp21(house_days(fx.meter_days(spark, d), dealt=True), fx.daily_weather(spark, d).where("n = 1").select("date", "temp_c"))
