"""Independent SQL (DuckDB dialect) for every registered query.

DuckDB sees only the base tables, so each statement inlines the fixture views it
needs as CTEs.  ``with_fx(body, *views)`` prepends them in dependency order.
"""

from __future__ import annotations

# DuckDB's round() keeps the sign of a tiny negative (-0.0) where
# Spark's decimal rounding gives 0.0; adding +0.0 normalises the zero.
def _positive_zero_rounds(sql: str) -> str:
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0::DOUBLE)")
        i = k + 1


def finalize() -> dict[str, str]:
    """The statements as handed to DuckDB (rounds normalised); SQL itself is unchanged."""
    return {key: _positive_zero_rounds(sql) for key, sql in SQL.items()}


FX: dict[str, str] = {
    "fx_team_games": """
SELECT game_id, CAST(DATE '2020-10-20' + CAST(floor(game_id / 6) AS INT) AS DATE) AS game_date,
       CAST(2020 + floor(game_id / 1000) AS INT) AS season, team_id, is_home, pts
FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS game_id,
             CAST(user_id % 30 AS BIGINT) AS team_id,
             CAST(1 - event_id % 2 AS INT) AS is_home,
             CAST(80 + floor(value) % 60 + 3 * ((user_id % 30) % 10) AS BIGINT) AS pts
      FROM events) e""",
    "fx_games": """
SELECT h.game_id, h.game_date, h.season, h.team_id AS home_team_id, h.pts AS home_pts,
       a.team_id AS away_team_id, a.pts AS away_pts,
       CASE WHEN h.pts > a.pts THEN 1 ELSE 0 END AS home_win
FROM fx_team_games h JOIN fx_team_games a ON h.game_id = a.game_id
WHERE h.is_home = 1 AND a.is_home = 0 AND h.team_id <> a.team_id
  AND h.game_id IN (SELECT game_id FROM fx_team_games GROUP BY game_id
                    HAVING sum(CASE WHEN is_home = 1 THEN 1 ELSE 0 END) = 1
                       AND sum(CASE WHEN is_home = 0 THEN 1 ELSE 0 END) = 1)""",
    "fx_long": """
SELECT game_id, game_date, season, home_team_id AS team_id, 1 AS is_home,
       home_pts AS pts_for, away_pts AS pts_against, home_win AS win FROM fx_games
UNION ALL
SELECT game_id, game_date, season, away_team_id AS team_id, 0 AS is_home,
       away_pts AS pts_for, home_pts AS pts_against, 1 - home_win AS win FROM fx_games""",
    "fx_pbp": """
SELECT game_id, action_number, period, team_code, is_field_goal, shot_result, shot_value,
       CASE WHEN shot_result = 'Made' THEN CAST(SUM(CASE WHEN team_code='HOM' AND shot_result='Made' THEN shot_value ELSE 0 END) OVER w AS VARCHAR) ELSE '' END AS score_home,
       CASE WHEN shot_result = 'Made' THEN CAST(SUM(CASE WHEN team_code='AWY' AND shot_result='Made' THEN shot_value ELSE 0 END) OVER w AS VARCHAR) ELSE '' END AS score_away
FROM (SELECT user_id AS game_id, event_id AS action_number,
             CAST(1 + floor((dayofmonth(ts) - 1) / (6 + user_id % 3)) AS INT) AS period,
             CASE WHEN event_type IN ('purchase','signup') THEN 'HOM' WHEN event_type IN ('click','view') THEN 'AWY' ELSE '' END AS team_code,
             CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_field_goal,
             CASE WHEN event_type = 'error' THEN NULL WHEN value < 50 THEN 'Made' ELSE 'Missed' END AS shot_result,
             CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS shot_value
      FROM events) x
WINDOW w AS (PARTITION BY game_id ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_odds_snapshots": """
SELECT event_id AS snapshot_id, user_id AS game_id,
       CASE event_id % 4 WHEN 0 THEN 'book_a' WHEN 1 THEN 'book_b' WHEN 2 THEN 'book_c' ELSE 'book_d' END AS book,
       CASE WHEN floor(event_id / 8) % 5 = 0 THEN 'totals' ELSE 'h2h' END AS market,
       CASE WHEN floor(event_id / 4) % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS side,
       CASE WHEN floor(value) % 2 = 0 THEN CAST(100 + floor(value) AS INT) ELSE CAST(-100 - floor(value) AS INT) END AS american_odds,
       ts AS captured_at
FROM events""",
    "fx_tipoffs": """
SELECT user_id AS game_id, CAST(MIN(ts) AS DATE) + CAST(15 + user_id % 10 AS INT) AS tip_date
FROM events GROUP BY user_id""",
    "fx_bets": """
SELECT o.o_orderkey AS bet_id, o.o_custkey AS user_id, b.game_id, b.book, b.market, b.side, b.american_odds AS odds_taken,
       CAST(1 + floor(o.o_totalprice / 10000) AS BIGINT) AS stake, o.o_orderdate AS placed_at,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 0 ELSE NULL END AS won
FROM orders o JOIN fx_odds_snapshots b ON o.o_orderkey = b.snapshot_id""",
    "fx_scores": """
SELECT l.doc_id, l.quality AS y,
       round(1.0 / (1.0 + exp(-(CAST(d.n_chars AS DOUBLE) - 1500.0) / 1500.0)), 4) AS p
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

_DEPS = {
    "fx_games": ["fx_team_games"],
    "fx_long": ["fx_games"],
    "fx_bets": ["fx_odds_snapshots"],
}


def _closure(views: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(v: str) -> None:
        for d in _DEPS.get(v, []):
            visit(d)
        if v not in out:
            out.append(v)

    for v in views:
        visit(v)
    return out


def with_fx(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture views (and extra named CTEs) it reads."""
    ctes = [f"{v} AS ({FX[v]}\n)" for v in _closure(views)]
    ctes += [f"{name} AS ({sql}\n)" for name, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body


SQL: dict[str, str] = {}

SQL["rolling_prior_form"] = with_fx("""
SELECT game_id, team_id, is_home,
       CAST(COUNT(pts_for) OVER w AS BIGINT) AS games_played,
       AVG(pts_for) OVER w AS roll_pts_for,
       AVG(pts_against) OVER w AS roll_pts_against,
       AVG(pts_for) OVER w - AVG(pts_against) OVER w AS roll_net_rating,
       AVG(win) OVER w AS roll_win_rate
FROM fx_long
WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
""", "fx_long")

SQL["rest_and_b2b"] = with_fx("""
SELECT game_id, team_id,
       CAST(LEAST(COALESCE(rd, 3), 7) AS INT) AS rest_days,
       CAST(CASE WHEN COALESCE(rd, 3) = 1 THEN 1 ELSE 0 END AS INT) AS b2b
FROM (SELECT game_id, team_id,
             CAST(date_diff('day', LAG(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id), game_date) AS INT) AS rd
      FROM fx_long) t
""", "fx_long")

SQL["explode_sides"] = with_fx("SELECT * FROM fx_long", "fx_long")

SQL["pair_home_away"] = with_fx("SELECT * FROM fx_games", "fx_games")

SQL["unpaired_rows"] = with_fx("""
SELECT * FROM fx_team_games
WHERE game_id IN (SELECT game_id FROM fx_team_games GROUP BY game_id
                  HAVING NOT (sum(CASE WHEN is_home = 1 THEN 1 ELSE 0 END) = 1
                          AND sum(CASE WHEN is_home = 0 THEN 1 ELSE 0 END) = 1
                          AND min(team_id) <> max(team_id)))
""", "fx_team_games")

SQL["season_ids"] = with_fx("""
SELECT CASE WHEN length(CAST(game_id AS VARCHAR)) < 10 THEN lpad(CAST(game_id AS VARCHAR), 10, '0')
            ELSE CAST(game_id AS VARCHAR) END AS game_id, game_date
FROM fx_games WHERE season = 2020
""", "fx_games")

SQL["table_profile"] = with_fx("""
SELECT 'pbp' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT game_id) AS BIGINT) AS n_keys,
       CAST(trunc(count(*) / count(DISTINCT game_id)) AS BIGINT) AS rows_per_key,
       CAST(NULL AS DATE) AS min_date, CAST(NULL AS DATE) AS max_date
FROM fx_pbp
UNION ALL
SELECT 'games', CAST(count(*) AS BIGINT), CAST(count(DISTINCT game_id) AS BIGINT),
       CAST(trunc(count(*) / count(DISTINCT game_id)) AS BIGINT), min(game_date), max(game_date)
FROM fx_games
""", "fx_pbp", "fx_games")

SQL["form_summary"] = with_fx("""
SELECT column_name, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max
FROM (UNPIVOT (SELECT CAST(games_played AS DOUBLE) AS games_played,
                      CAST(roll_pts_for AS DOUBLE) AS roll_pts_for,
                      CAST(roll_pts_against AS DOUBLE) AS roll_pts_against,
                      CAST(roll_pts_for - roll_pts_against AS DOUBLE) AS roll_net_rating,
                      CAST(roll_win_rate AS DOUBLE) AS roll_win_rate,
                      CAST(rest_days AS DOUBLE) AS rest_days, CAST(b2b AS DOUBLE) AS b2b
               FROM form)
       ON games_played, roll_pts_for, roll_pts_against, roll_net_rating, roll_win_rate, rest_days, b2b
       INTO NAME column_name VALUE value) u
GROUP BY column_name
""", "fx_long", extra=[("form", """
SELECT COUNT(pts_for) OVER w AS games_played,
       AVG(pts_for) OVER w AS roll_pts_for, AVG(pts_against) OVER w AS roll_pts_against,
       AVG(win) OVER w AS roll_win_rate,
       LEAST(COALESCE(date_diff('day', LAG(game_date) OVER w1, game_date), 3), 7) AS rest_days,
       CASE WHEN COALESCE(date_diff('day', LAG(game_date) OVER w1, game_date), 3) = 1 THEN 1 ELSE 0 END AS b2b
FROM fx_long
WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
       w1 AS (PARTITION BY team_id ORDER BY game_date, game_id)""")])

SQL["new_ids"] = with_fx("""
SELECT lpad(CAST(game_id AS VARCHAR), 10, '0') AS game_id FROM fx_games
WHERE CAST(game_id AS BIGINT) NOT IN (SELECT DISTINCT game_id FROM fx_pbp)
""", "fx_games", "fx_pbp")

_SCORED = ("scored", """
SELECT *, COALESCE(last_value(sh IGNORE NULLS) OVER w, 0) AS home_score,
          COALESCE(last_value(sa IGNORE NULLS) OVER w, 0) AS away_score
FROM (SELECT *, CASE WHEN score_home = '' THEN NULL ELSE TRY_CAST(score_home AS INT) END AS sh,
                CASE WHEN score_away = '' THEN NULL ELSE TRY_CAST(score_away AS INT) END AS sa,
                CAST(is_field_goal AS INT) AS fg,
                CAST(shot_result = 'Made' AS INT) AS made,
                CAST((TRY_CAST(shot_value AS INT) = 3) AND (shot_result = 'Made') AS INT) AS three
      FROM fx_pbp) c
WINDOW w AS (PARTITION BY game_id ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_SIGNED = ("signed", """
SELECT *, home_score - away_score AS margin, CAST(sign(home_score - away_score) AS INT) AS sign FROM scored""")
_LEADS = ("leads", """
SELECT game_id, CAST(sum(CASE WHEN prev_sign IS NOT NULL AND sign <> prev_sign THEN 1 ELSE 0 END) AS BIGINT) AS lead_changes
FROM (SELECT game_id, sign, LAG(sign) OVER (PARTITION BY game_id ORDER BY action_number) AS prev_sign
      FROM signed WHERE sign <> 0) nz
GROUP BY game_id""")

SQL["running_score"] = with_fx("""
SELECT game_id, action_number, home_score, away_score, margin, sign FROM signed
""", "fx_pbp", extra=[_SCORED, _SIGNED])

SQL["lead_changes"] = with_fx("""
SELECT g.game_id, CAST(COALESCE(l.lead_changes, 0) AS BIGINT) AS lead_changes
FROM (SELECT DISTINCT game_id FROM signed) g LEFT JOIN leads l ON g.game_id = l.game_id
""", "fx_pbp", extra=[_SCORED, _SIGNED, _LEADS])

SQL["contest_rollup"] = with_fx("""
SELECT g.*, CASE WHEN num_periods > 4 THEN 1 ELSE 0 END AS overtime,
       CAST(COALESCE(l.lead_changes, 0) AS BIGINT) AS lead_changes
FROM (SELECT game_id, CAST(count(*) AS BIGINT) AS total_events, max(period) AS num_periods,
             max(home_score) AS home_final, max(away_score) AS away_final, max(abs(margin)) AS max_abs_margin,
             CAST(sum(made) AS BIGINT) AS total_fg_made, CAST(sum(three) AS BIGINT) AS total_three_made
      FROM signed GROUP BY game_id) g
LEFT JOIN leads l ON g.game_id = l.game_id
""", "fx_pbp", extra=[_SCORED, _SIGNED, _LEADS])

SQL["side_rollup"] = with_fx("""
SELECT game_id, team_code, fg_att, fg_made, threes_made,
       round(CAST(fg_made AS DOUBLE) / NULLIF(fg_att, 0), 3) AS fg_pct
FROM (SELECT game_id, team_code, CAST(sum(fg) AS BIGINT) AS fg_att, CAST(sum(made) AS BIGINT) AS fg_made,
             CAST(sum(three) AS BIGINT) AS threes_made
      FROM scored WHERE team_code IS NOT NULL AND team_code <> '' GROUP BY game_id, team_code) s
""", "fx_pbp", extra=[_SCORED])


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def implied(o: str) -> str:
    return (f"(CASE WHEN {o} > 0 THEN 100.0::DOUBLE / ({dbl(o)} + 100.0::DOUBLE) "
            f"ELSE -{dbl(o)} / (-{dbl(o)} + 100.0::DOUBLE) END)")


def decimal_odds(o: str) -> str:
    return (f"(CASE WHEN {o} > 0 THEN {dbl(o)} / 100.0::DOUBLE + 1.0::DOUBLE "
            f"ELSE 100.0::DOUBLE / (-{dbl(o)}) + 1.0::DOUBLE END)")


def ev(p: str, o: str) -> str:
    return f"({p} * ({decimal_odds(o)} - 1.0::DOUBLE) - (1.0::DOUBLE - {p}))"


def kelly(p: str, o: str) -> str:
    b = f"({decimal_odds(o)} - 1.0::DOUBLE)"
    return f"greatest(0.0::DOUBLE, ({b} * {p} - (1.0::DOUBLE - {p})) / {b})"


def stake(p: str, o: str) -> str:
    return f"least(0.05::DOUBLE, 0.25::DOUBLE * {kelly(p, o)})"


def r6(x: str) -> str:
    return f"round({x}, 6)"


_LATEST = ("latest", """
SELECT game_id, book, market, side, american_odds, captured_at FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, book, market, side
                               ORDER BY captured_at DESC, snapshot_id DESC) AS rn
  FROM fx_odds_snapshots) t WHERE rn = 1""")
_TWO = ("two", """
SELECT game_id, book, market,
       max(CASE WHEN side = 'HOME' THEN american_odds END) AS home_odds,
       max(CASE WHEN side = 'AWAY' THEN american_odds END) AS away_odds
FROM latest GROUP BY game_id, book, market
HAVING max(CASE WHEN side = 'HOME' THEN american_odds END) IS NOT NULL
   AND max(CASE WHEN side = 'AWAY' THEN american_odds END) IS NOT NULL""")
_FAIR = ("fair", f"""
SELECT *, implied_home + implied_away AS overround,
       implied_home / (implied_home + implied_away) AS fair_home,
       implied_away / (implied_away + implied_home) AS fair_away
FROM (SELECT *, {implied('home_odds')} AS implied_home, {implied('away_odds')} AS implied_away FROM two) t""")
_CONS = ("cons", """
SELECT game_id, market, avg(fair_home) AS p_home, count(*) AS n_books FROM fair GROUP BY game_id, market""")
_MARKET = [_LATEST, _TWO, _FAIR, _CONS]

SQL["devig_market"] = with_fx(f"""
SELECT game_id, book, market, home_odds, away_odds, {r6('implied_home')} AS implied_home,
       {r6('implied_away')} AS implied_away, {r6('overround')} AS overround,
       {r6('fair_home')} AS fair_home, {r6('fair_away')} AS fair_away
FROM fair""", "fx_odds_snapshots", extra=_MARKET)

SQL["odds_columns"] = with_fx(f"""
SELECT snapshot_id, game_id, book, side, american_odds, {r6('p')} AS p,
       {r6(decimal_odds('american_odds'))} AS decimal_odds, {r6(implied('american_odds'))} AS implied,
       {r6('p - ' + implied('american_odds'))} AS edge, {r6(ev('p', 'american_odds'))} AS ev,
       {r6(kelly('p', 'american_odds'))} AS kelly, {r6(stake('p', 'american_odds'))} AS stake_frac
FROM (SELECT s.*, CASE WHEN s.side = 'HOME' THEN c.p_home ELSE 1.0::DOUBLE - c.p_home END AS p
      FROM fx_odds_snapshots s JOIN cons c ON s.game_id = c.game_id AND s.market = c.market) x
""", "fx_odds_snapshots", extra=_MARKET)

SQL["best_side"] = with_fx(f"""
SELECT game_id, market, side AS pick, book, odds, {r6('p')} AS p_model, {r6(implied('odds'))} AS implied,
       {r6('p - ' + implied('odds'))} AS edge, {r6('ev')} AS ev, {r6(stake('p', 'odds'))} AS kelly_stake
FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market
                                   ORDER BY ev DESC, side DESC, book DESC, odds DESC, p DESC) AS rn
      FROM (SELECT *, {ev('p', 'odds')} AS ev FROM (
              SELECT f.game_id, f.market, f.book, 'HOME' AS side, f.home_odds AS odds, c.p_home AS p
              FROM fair f JOIN cons c ON f.game_id = c.game_id AND f.market = c.market
              UNION ALL
              SELECT f.game_id, f.market, f.book, 'AWAY', f.away_odds, 1.0::DOUBLE - c.p_home
              FROM fair f JOIN cons c ON f.game_id = c.game_id AND f.market = c.market) u) e) r
WHERE rn = 1
""", "fx_odds_snapshots", extra=_MARKET)


def to_american(p: str, vig: float) -> str:
    pv = f"least(0.98::DOUBLE, {p} * (1.0::DOUBLE + {vig}::DOUBLE))"
    dec = f"(1.0::DOUBLE / {pv})"
    return (f"CAST(CASE WHEN {dec} >= 2.0 THEN round_even(({dec} - 1.0::DOUBLE) * 100.0::DOUBLE, 0) "
            f"ELSE round_even(-100.0::DOUBLE / ({dec} - 1.0::DOUBLE), 0) END AS INT)")


SQL["prob_to_odds"] = with_fx(f"""
SELECT game_id, market, round(p, 6) AS p_home, {to_american('p', 0.045)} AS home_price,
       {to_american('(1.0::DOUBLE - p)', 0.045)} AS away_price
FROM (SELECT game_id, market, p_home AS p FROM cons) c
""", "fx_odds_snapshots", extra=_MARKET)

SQL["odds_payload_flatten"] = with_fx("""
SELECT d.game_id, d.poll_day, 'H' || CAST(d.game_id AS VARCHAR) AS home,
       'A' || CAST(d.game_id AS VARCHAR) AS away, strftime(t.tip_date, '%Y-%m-%d') AS commence,
       d.book, d.home_odds, d.away_odds
FROM (SELECT game_id, CAST(captured_at AS DATE) AS poll_day, book,
             arg_max(CASE WHEN side = 'HOME' THEN american_odds END, CASE WHEN side = 'HOME' THEN captured_at END) AS home_odds,
             arg_max(CASE WHEN side = 'AWAY' THEN american_odds END, CASE WHEN side = 'AWAY' THEN captured_at END) AS away_odds
      FROM fx_odds_snapshots WHERE market = 'h2h'
      GROUP BY game_id, CAST(captured_at AS DATE), book) d
JOIN fx_tipoffs t ON d.game_id = t.game_id
WHERE d.home_odds IS NOT NULL AND d.away_odds IS NOT NULL
""", "fx_odds_snapshots", "fx_tipoffs")

# Sequential ratings: a recursive CTE that walks games in (date, id) order carrying
# one rating per team slot.
_ELO = [("teams", """
SELECT team_id, row_number() OVER (ORDER BY team_id) AS slot
FROM (SELECT home_team_id AS team_id FROM fx_games UNION SELECT away_team_id FROM fx_games) t"""),
        ("gseq", """
SELECT row_number() OVER (ORDER BY f.game_date, f.game_id) AS rn, f.game_id, f.season,
       th.slot AS h, ta.slot AS a, CAST(f.home_win AS DOUBLE) AS res
FROM fx_games f JOIN teams th ON f.home_team_id = th.team_id JOIN teams ta ON f.away_team_id = ta.team_id"""),
        ("elo", """
SELECT 0::BIGINT AS rn, NULL::INT AS season,
       list_transform(range((SELECT count(*) FROM teams)), lambda x: 1500.0::DOUBLE) AS r,
       NULL::BIGINT AS game_id, NULL::DOUBLE AS home_elo, NULL::DOUBLE AS away_elo, NULL::DOUBLE AS ex
UNION ALL
SELECT rn, season,
       list_transform(range(1, len(r0) + 1), lambda i: CASE WHEN i = h THEN rh + 20.0::DOUBLE * (res - ex)
                                                      WHEN i = a THEN ra + 20.0::DOUBLE * ((1.0::DOUBLE - res) - (1.0::DOUBLE - ex))
                                                      ELSE r0[i] END),
       game_id, rh, ra, ex
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (ra - (rh + 60.0::DOUBLE)) / 400.0::DOUBLE)) AS ex
      FROM (SELECT *, r0[h] AS rh, r0[a] AS ra
            FROM (SELECT g.rn, g.season, g.game_id, g.h, g.a, g.res,
                         CASE WHEN e.season IS NULL OR g.season <> e.season
                              THEN list_transform(e.r, lambda x: 1500.0::DOUBLE + 0.75::DOUBLE * (x - 1500.0::DOUBLE))
                              ELSE e.r END AS r0
                  FROM elo e JOIN gseq g ON g.rn = e.rn + 1) s1) s2) s3"""),
        ("game_elo", """
SELECT game_id, home_elo, away_elo, (home_elo + 60.0::DOUBLE) - away_elo AS elo_diff, ex AS elo_exp_home
FROM elo WHERE rn > 0""")]


def with_elo(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    sql = with_fx(body, "fx_games", *views, extra=_ELO + (extra or []))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SQL["elo_by_pool"] = with_elo("""
SELECT game_id, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo,
       round(elo_diff, 6) AS elo_diff, round(elo_exp_home, 6) AS elo_exp_home
FROM game_elo""")
SQL["elo_relaxed"] = SQL["elo_by_pool"]

_FORM = ("form", """
SELECT game_id, team_id, is_home, game_date,
       CAST(COUNT(pts_for) OVER w AS BIGINT) AS games_played,
       AVG(pts_for) OVER w AS roll_pts_for, AVG(pts_against) OVER w AS roll_pts_against,
       AVG(pts_for) OVER w - AVG(pts_against) OVER w AS roll_net_rating,
       AVG(win) OVER w AS roll_win_rate,
       CAST(LEAST(COALESCE(date_diff('day', LAG(game_date) OVER w1, game_date), 3), 7) AS INT) AS rest_days,
       CAST(CASE WHEN COALESCE(date_diff('day', LAG(game_date) OVER w1, game_date), 3) = 1 THEN 1 ELSE 0 END AS INT) AS b2b
FROM fx_long
WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
       w1 AS (PARTITION BY team_id ORDER BY game_date, game_id)""")
_FF = ("ff", """
SELECT g.game_id, g.game_date, g.season, g.home_team_id, g.away_team_id, g.home_win,
       h.roll_pts_for - a.roll_pts_for AS diff_pts_for,
       h.roll_pts_against - a.roll_pts_against AS diff_pts_against,
       h.roll_net_rating - a.roll_net_rating AS diff_net,
       h.roll_win_rate - a.roll_win_rate AS diff_win_rate,
       h.rest_days AS home_rest, a.rest_days AS away_rest, h.b2b AS home_b2b, a.b2b AS away_b2b,
       e.elo_diff, e.elo_exp_home
FROM fx_games g
JOIN form h ON g.game_id = h.game_id AND g.home_team_id = h.team_id
JOIN form a ON g.game_id = a.game_id AND g.away_team_id = a.team_id
JOIN game_elo e ON g.game_id = e.game_id
WHERE h.roll_pts_for IS NOT NULL AND a.roll_pts_for IS NOT NULL
  AND h.roll_pts_against IS NOT NULL AND a.roll_pts_against IS NOT NULL
  AND h.roll_win_rate IS NOT NULL AND a.roll_win_rate IS NOT NULL
  AND e.elo_diff IS NOT NULL AND e.elo_exp_home IS NOT NULL AND g.home_win IS NOT NULL""")

SQL["feature_frame"] = with_elo("""
SELECT game_id, game_date, season, home_team_id, away_team_id, home_win,
       round(diff_pts_for, 6) AS diff_pts_for, round(diff_pts_against, 6) AS diff_pts_against,
       round(diff_net, 6) AS diff_net, round(diff_win_rate, 6) AS diff_win_rate,
       home_rest, away_rest, home_b2b, away_b2b,
       round(elo_diff, 6) AS elo_diff, round(elo_exp_home, 6) AS elo_exp_home
FROM ff""", "fx_long", extra=[_FORM, _FF])

SQL["latest_form"] = with_elo("""
SELECT lf.team_id, round(lf.roll_pts_for, 6) AS roll_pts_for,
       round(lf.roll_pts_against, 6) AS roll_pts_against,
       round(lf.roll_net_rating, 6) AS roll_net_rating, round(lf.roll_win_rate, 6) AS roll_win_rate,
       round(COALESCE(le.elo, 1500.0::DOUBLE), 6) AS elo
FROM (SELECT * FROM (SELECT team_id, roll_pts_for, roll_pts_against, roll_net_rating, roll_win_rate,
                            row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn
                     FROM form) x WHERE rn = 1) lf
LEFT JOIN (SELECT * FROM (SELECT team_id, elo,
                                 row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn
                          FROM (SELECT g.home_team_id AS team_id, g.game_date, g.game_id, e.home_elo AS elo
                                FROM fx_games g JOIN game_elo e ON g.game_id = e.game_id
                                UNION ALL
                                SELECT g.away_team_id, g.game_date, g.game_id, e.away_elo
                                FROM fx_games g JOIN game_elo e ON g.game_id = e.game_id) s) y
           WHERE rn = 1) le ON lf.team_id = le.team_id""", "fx_long", extra=[_FORM])

SQL["time_split"] = with_elo("""
SELECT game_id, game_date, pos,
       CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
            WHEN pos < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT game_id, game_date, CAST(row_number() OVER (ORDER BY game_date, game_id) - 1 AS BIGINT) AS pos,
             count(*) OVER () AS n FROM ff) t""", "fx_long", extra=[_FORM, _FF])


_SCORED_LONG = ("scored_long", """
SELECT 'doc_score' AS model, y, p FROM fx_scores
UNION ALL
SELECT 'elo_baseline', home_win, elo_exp_home
FROM (SELECT *, row_number() OVER (ORDER BY game_date, game_id) - 1 AS pos, count(*) OVER () AS n FROM ff) t
WHERE pos >= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))""")

SQL["prob_metrics"] = with_elo("""
SELECT m.model, m.n, round(m.log_loss, 4) AS log_loss, round(m.brier, 4) AS brier,
       round(m.accuracy, 4) AS accuracy, round(a.auc, 4) AS auc
FROM (SELECT model, CAST(count(*) AS BIGINT) AS n,
             -avg(y * ln(pc) + (1 - y) * ln(1 - pc)) AS log_loss,
             avg((p - y) * (p - y)) AS brier,
             avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
      FROM (SELECT *, least(greatest(p, 2.220446049250313e-16::DOUBLE), 1.0::DOUBLE - 2.220446049250313e-16::DOUBLE) AS pc
            FROM scored_long) c GROUP BY model) m
JOIN (SELECT model, (sum(CASE WHEN y = 1 THEN rnk END) - np * (np + 1) / 2.0) / (np * nn) AS auc
      FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rnk,
                   sum(y) OVER (PARTITION BY model) AS np, sum(1 - y) OVER (PARTITION BY model) AS nn
            FROM scored_long) r GROUP BY model, np, nn) a ON m.model = a.model
""", "fx_long", "fx_scores", extra=[_FORM, _FF, _SCORED_LONG])

SQL["calibration_bins"] = with_elo("""
SELECT s.model, CAST(len(list_filter(e.edges, lambda x: x < s.p)) AS INT) AS bin,
       CAST(count(*) AS BIGINT) AS n, round(avg(s.p), 6) AS mean_pred, round(avg(CAST(s.y AS DOUBLE)), 6) AS frac_pos
FROM scored_long s
JOIN (SELECT model, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
      FROM scored_long GROUP BY model) e ON s.model = e.model
GROUP BY s.model, bin
""", "fx_long", "fx_scores", extra=[_FORM, _FF, _SCORED_LONG])

SQL["isotonic_calibrate"] = with_fx("""
SELECT s.doc_id, s.y, s.p, round(f.fitv, 6) AS p_cal
FROM fx_scores s JOIN fit f ON s.p = f.p
""", "fx_scores", extra=[
    ("u", "SELECT p, CAST(sum(y) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS w FROM fx_scores GROUP BY p"),
    ("kn", """SELECT p, sy, w, row_number() OVER (ORDER BY p) AS i,
                     sum(sy) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cs,
                     sum(w) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cw FROM u"""),
    ("blocks", """SELECT a.i AS j, b.i AS k, (b.cs - (a.cs - a.sy)) / (b.cw - (a.cw - a.w)) AS m
                  FROM kn a JOIN kn b ON a.i <= b.i"""),
    ("fit", """SELECT kn.p, max(mn) AS fitv FROM (
                 SELECT x.i, bl.j, min(bl.m) AS mn FROM kn x JOIN blocks bl ON bl.j <= x.i AND bl.k >= x.i
                 GROUP BY x.i, bl.j) t JOIN kn ON kn.i = t.i GROUP BY kn.p""")])


_LATEST_FORM = ("latest_tf", """
SELECT lf.team_id, lf.roll_pts_for, lf.roll_pts_against, lf.roll_net_rating, lf.roll_win_rate,
       COALESCE(le.elo, 1500.0::DOUBLE) AS elo
FROM (SELECT * FROM (SELECT team_id, roll_pts_for, roll_pts_against, roll_net_rating, roll_win_rate,
                            row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn
                     FROM form) x WHERE rn = 1) lf
LEFT JOIN (SELECT * FROM (SELECT team_id, elo,
                                 row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn
                          FROM (SELECT g.home_team_id AS team_id, g.game_date, g.game_id, e.home_elo AS elo
                                FROM fx_games g JOIN game_elo e ON g.game_id = e.game_id
                                UNION ALL
                                SELECT g.away_team_id, g.game_date, g.game_id, e.away_elo
                                FROM fx_games g JOIN game_elo e ON g.game_id = e.game_id) s) y
           WHERE rn = 1) le ON lf.team_id = le.team_id""")
_RATED = ("rated", """
SELECT u.game_id, u.home_team_id, u.away_team_id,
       1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (a.elo - (h.elo + 60.0::DOUBLE)) / 400.0::DOUBLE)) AS p_home
FROM (SELECT t.game_id, g.home_team_id, g.away_team_id FROM fx_tipoffs t JOIN fx_games g ON t.game_id = g.game_id) u
JOIN latest_tf h ON u.home_team_id = h.team_id JOIN latest_tf a ON u.away_team_id = a.team_id""")


def best_of(cands: str) -> str:
    """Best (ev, side, book, odds, p) per game from a (game_id, book, side, odds, p) set."""
    return (f"SELECT game_id, side AS pick, book, odds, p AS p_model, {implied('odds')} AS implied, "
            f"p - {implied('odds')} AS edge, ev, {stake('p', 'odds')} AS kelly_stake "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY game_id "
            f"ORDER BY ev DESC, side DESC, book DESC, odds DESC, p DESC) AS rn "
            f"FROM (SELECT *, {ev('p', 'odds')} AS ev FROM ({cands}) c0) c1) c2 WHERE rn = 1")


def display(p_home: str, edge: str, ev_: str, kelly_stake: str) -> str:
    return (f"printf('%.1f%%', {p_home} * 100.0::DOUBLE) AS p_home_pct, "
            f"printf('%.1f%%', {edge} * 100.0::DOUBLE) AS edge_pct, "
            f"printf('%+.2f', {ev_}) AS ev_unit, "
            f"printf('%.1f%%', {kelly_stake} * 100.0::DOUBLE) || ' of bankroll' AS stake_text")


_BOARD_CANDS = """SELECT t.game_id, t.book, 'HOME' AS side, t.home_odds AS odds, r.p_home AS p
FROM two t JOIN rated r ON t.game_id = r.game_id WHERE t.market = 'h2h'
UNION ALL
SELECT t.game_id, t.book, 'AWAY', t.away_odds, 1.0::DOUBLE - r.p_home
FROM two t JOIN rated r ON t.game_id = r.game_id WHERE t.market = 'h2h'"""
_BOARD = ("brd", f"""
SELECT r.game_id, ac.n_name || ' @ ' || hc.n_name AS matchup, r.p_home, 'live' AS source,
       b.pick, b.book, b.odds, b.p_model, b.implied, b.edge, b.ev, b.kelly_stake
FROM rated r
JOIN nation hc ON r.home_team_id = CAST(hc.n_nationkey AS BIGINT)
JOIN nation ac ON r.away_team_id = CAST(ac.n_nationkey AS BIGINT)
JOIN ({best_of(_BOARD_CANDS)}) b ON r.game_id = b.game_id""")
_BOARD_CTES = [_FORM, _LATEST_FORM, _RATED, _LATEST, _TWO, _BOARD]

SQL["board"] = with_elo(f"""
SELECT game_id, matchup, round(p_home, 6) AS p_home, source, pick, book, odds, round(p_model, 6) AS p_model,
       round(implied, 6) AS implied, round(edge, 6) AS edge, round(ev, 6) AS ev,
       round(kelly_stake, 6) AS kelly_stake, {display('p_home', 'edge', 'ev', 'kelly_stake')}
FROM brd""", "fx_long", "fx_tipoffs", "fx_odds_snapshots", extra=_BOARD_CTES)

SQL["board_kpis"] = with_elo("""
SELECT CAST(count(*) AS BIGINT) AS n_games, CAST(sum(CASE WHEN ev > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_value,
       round(max(edge), 6) AS best_edge
FROM brd""", "fx_long", "fx_tipoffs", "fx_odds_snapshots", extra=_BOARD_CTES)

_HELDOUT = ("heldout", """
SELECT game_id, game_date, home_team_id, away_team_id, home_win, elo_exp_home AS p_model,
       1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (0.0::DOUBLE - (elo_diff - 60.0::DOUBLE)) / 400.0::DOUBLE)) AS p_market
FROM (SELECT *, row_number() OVER (ORDER BY game_date, game_id) - 1 AS pos, count(*) OVER () AS n FROM ff) t
WHERE pos >= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))""")
_SAMPLE = ("smp", """
SELECT * FROM heldout ORDER BY md5('7' || CAST(game_id AS VARCHAR)) LIMIT 8""")

SQL["seeded_sample"] = with_elo("""
SELECT game_id, game_date, home_team_id, away_team_id, home_win,
       round(p_model, 6) AS p_model, round(p_market, 6) AS p_market FROM smp
""", "fx_long", extra=[_FORM, _FF, _HELDOUT, _SAMPLE])

_SAMPLE_CANDS = (f"SELECT game_id, 'SampleBook' AS book, 'HOME' AS side, "
                 f"{to_american('p_market', 0.045)} AS odds, p_model AS p FROM smp "
                 f"UNION ALL SELECT game_id, 'SampleBook', 'AWAY', "
                 f"{to_american('(1.0::DOUBLE - p_market)', 0.045)}, 1.0::DOUBLE - p_model FROM smp")

SQL["heldout_board"] = with_elo(f"""
SELECT s.game_id, CAST(s.away_team_id AS VARCHAR) || ' @ ' || CAST(s.home_team_id AS VARCHAR) AS matchup,
       round(s.p_model, 6) AS p_home, 'sample' AS source,
       CASE WHEN s.home_win = 1 THEN 'HOME win' ELSE 'AWAY win' END AS result,
       b.pick, b.book, b.odds, round(b.p_model, 6) AS p_model, round(b.implied, 6) AS implied,
       round(b.edge, 6) AS edge, round(b.ev, 6) AS ev, round(b.kelly_stake, 6) AS kelly_stake,
       {display('s.p_model', 'b.edge', 'b.ev', 'b.kelly_stake')}
FROM smp s JOIN ({best_of(_SAMPLE_CANDS)}) b ON s.game_id = b.game_id
""", "fx_long", extra=[_FORM, _FF, _HELDOUT, _SAMPLE])

_TIPS = ("tips", "SELECT game_id, CAST(tip_date AS TIMESTAMP) AS tip_ts FROM fx_tipoffs")
_PRETIP = ("pretip", """
SELECT s.* FROM fx_odds_snapshots s JOIN tips t ON s.game_id = t.game_id WHERE s.captured_at < t.tip_ts""")
_CLOSE = ("closing", """
SELECT game_id, book, market, side, american_odds AS closing_odds, captured_at AS closing_at FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, book, market, side
                               ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM pretip) t
WHERE rn = 1""")

SQL["closing_line"] = with_fx("SELECT * FROM closing", "fx_odds_snapshots", "fx_tipoffs",
                              extra=[_TIPS, _PRETIP, _CLOSE])

SQL["line_movement"] = with_fx(f"""
SELECT game_id, book, market, side, open_odds, close_odds, n_snapshots, n_changes,
       round({implied('open_odds')}, 6) AS implied_open, round({implied('close_odds')}, 6) AS implied_close,
       round({implied('close_odds')} - {implied('open_odds')}, 6) AS implied_move
FROM (SELECT game_id, book, market, side,
             first(american_odds ORDER BY captured_at, snapshot_id) AS open_odds,
             last(american_odds ORDER BY captured_at, snapshot_id) AS close_odds,
             CAST(count(*) AS BIGINT) AS n_snapshots,
             CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> american_odds THEN 1 ELSE 0 END) AS BIGINT) AS n_changes
      FROM (SELECT *, lag(american_odds) OVER (PARTITION BY game_id, book, market, side
                                                ORDER BY captured_at, snapshot_id) AS prev
            FROM pretip) p
      GROUP BY game_id, book, market, side) m
""", "fx_odds_snapshots", "fx_tipoffs", extra=[_TIPS, _PRETIP])

SQL["line_shopping"] = with_fx(f"""
SELECT l.game_id, l.book, l.market, l.side, l.american_odds, round(l.dec, 6) AS decimal_odds,
       round(s.best, 6) AS best_decimal, round(s.med, 6) AS median_decimal, s.n_books,
       l.dec = s.best AS is_best, round(s.best / s.med - 1.0::DOUBLE, 6) AS save_pct
FROM (SELECT *, {decimal_odds('american_odds')} AS dec FROM latest) l
JOIN (SELECT game_id, market, side, max({decimal_odds('american_odds')}) AS best,
             median({decimal_odds('american_odds')}) AS med, CAST(count(*) AS BIGINT) AS n_books
      FROM latest GROUP BY game_id, market, side) s
  ON l.game_id = s.game_id AND l.market = s.market AND l.side = s.side
""", "fx_odds_snapshots", extra=[_LATEST])

SQL["clv_records"] = with_fx(f"""
SELECT b.bet_id, b.user_id, b.game_id, b.book, b.market, b.side, b.odds_taken, c.closing_odds,
       round({implied('c.closing_odds')} - {implied('b.odds_taken')}, 6) AS clv,
       ({implied('c.closing_odds')} - {implied('b.odds_taken')}) > 0 AS beat_close
FROM fx_bets b LEFT JOIN closing c ON b.game_id = c.game_id AND b.book = c.book AND b.market = c.market
     AND b.side = c.side
""", "fx_bets", "fx_tipoffs", extra=[_TIPS, _PRETIP, _CLOSE])

_SETTLED = ("settled", f"""
SELECT *, CASE WHEN won = 1 THEN stake * ({decimal_odds('odds_taken')} - 1.0::DOUBLE)
               WHEN won = 0 THEN -CAST(stake AS DOUBLE) END AS profit
FROM fx_bets""")

SQL["bet_ledger"] = with_fx("""
SELECT bet_id, user_id, placed_at, stake, odds_taken, won, round(profit, 6) AS profit,
       round(cum_profit, 6) AS cum_profit, round(cum_staked, 6) AS cum_staked,
       round(CASE WHEN cum_staked = 0 THEN NULL ELSE cum_profit / cum_staked END, 6) AS running_roi
FROM (SELECT *, COALESCE(sum(profit) OVER w, 0) AS cum_profit,
             COALESCE(sum(CASE WHEN profit IS NOT NULL THEN CAST(stake AS DOUBLE) END) OVER w, 0) AS cum_staked
      FROM settled
      WINDOW w AS (PARTITION BY user_id ORDER BY placed_at, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
""", "fx_bets", extra=[_SETTLED])

SQL["ledger_summary"] = with_fx("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n_bets, CAST(count(profit) AS BIGINT) AS n_settled,
       CAST(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_won,
       CAST(sum(CASE WHEN profit IS NOT NULL THEN stake END) AS BIGINT) AS staked,
       round(sum(profit), 6) AS profit,
       round(CASE WHEN count(profit) = 0 THEN NULL ELSE sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) / count(profit) END, 6) AS hit_rate,
       round(sum(profit) / NULLIF(sum(CASE WHEN profit IS NOT NULL THEN stake END), 0), 6) AS roi
FROM settled GROUP BY user_id
""", "fx_bets", extra=[_SETTLED])

_BT = ("bt", f"""
SELECT *, CASE WHEN won THEN stk * ({decimal_odds('open_odds')} - 1.0::DOUBLE) ELSE -stk END AS profit,
       {implied('close_odds')} - {implied('open_odds')} AS clv
FROM (SELECT *, {stake('p', 'open_odds')} AS stk, (side = 'HOME') = (home_win = 1) AS won
      FROM (SELECT oc.*, g.home_win,
                   CASE WHEN oc.side = 'HOME' THEN e.elo_exp_home ELSE 1.0::DOUBLE - e.elo_exp_home END AS p
            FROM (SELECT game_id, book, market, side,
                         first(american_odds ORDER BY captured_at, snapshot_id) AS open_odds,
                         last(american_odds ORDER BY captured_at, snapshot_id) AS close_odds
                  FROM pretip WHERE market = 'h2h' GROUP BY game_id, book, market, side) oc
            JOIN fx_games g ON oc.game_id = g.game_id JOIN game_elo e ON oc.game_id = e.game_id) x
      WHERE {ev('p', 'open_odds')} > 0) y""")

SQL["backtest"] = with_elo("""
SELECT book, CAST(count(*) AS BIGINT) AS n_bets, round(sum(stk), 6) AS staked, round(sum(profit), 6) AS profit,
       round(avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate,
       round(avg(clv), 6) AS avg_clv,
       round(avg(CASE WHEN clv > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_beat_close,
       round(sum(profit) / NULLIF(sum(stk), 0), 6) AS roi
FROM bt GROUP BY book""", "fx_odds_snapshots", "fx_tipoffs", extra=[_TIPS, _PRETIP, _BT])

SQL["walk_forward"] = with_elo("""
SELECT fold, model, CAST(count(*) AS BIGINT) AS n,
       round(-avg(y * ln(pc) + (1 - y) * ln(1 - pc)), 4) AS log_loss,
       round(avg((p - y) * (p - y)), 4) AS brier,
       round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy,
       round(max(auc), 4) AS auc
FROM (SELECT *, least(greatest(p, 2.220446049250313e-16::DOUBLE), 1.0::DOUBLE - 2.220446049250313e-16::DOUBLE) AS pc,
             (sum(CASE WHEN y = 1 THEN rnk END) OVER (PARTITION BY fold, model)
              - np * (np + 1) / 2.0) / (np * nn) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY fold, model ORDER BY p)
                      + (count(*) OVER (PARTITION BY fold, model, p) - 1) / 2.0 AS rnk,
                   sum(y) OVER (PARTITION BY fold, model) AS np,
                   sum(1 - y) OVER (PARTITION BY fold, model) AS nn
            FROM long) r) q
GROUP BY fold, model""", extra=[("sg", """
SELECT g.season, g.game_date, g.home_win AS y, e.elo_exp_home AS p,
       least(floor(e.elo_exp_home * 10), 9) AS bin
FROM fx_games g JOIN game_elo e ON g.game_id = e.game_id"""),
    ("ords", """SELECT season, dense_rank() OVER (ORDER BY first_date, season) AS ord
                FROM (SELECT season, min(game_date) AS first_date FROM sg GROUP BY season) f"""),
    ("hist", """SELECT bin, ord,
                       COALESCE(sum(pos) OVER (PARTITION BY bin ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hp,
                       COALESCE(sum(n) OVER (PARTITION BY bin ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hn
                FROM (SELECT bin, ord, sum(y) AS pos, count(*) AS n FROM sg JOIN ords USING (season) GROUP BY bin, ord) c"""),
    ("long", """SELECT sg.season AS fold, 'raw' AS model, sg.y, sg.p
                FROM sg JOIN ords USING (season) JOIN hist ON hist.bin = sg.bin AND hist.ord = ords.ord WHERE ords.ord >= 2
                UNION ALL
                SELECT sg.season, 'binned', sg.y, (hist.hp + sg.p) / (hist.hn + 1.0::DOUBLE)
                FROM sg JOIN ords USING (season) JOIN hist ON hist.bin = sg.bin AND hist.ord = ords.ord WHERE ords.ord >= 2""")])

SQL["trial_ids"] = with_fx("""
SELECT game_id, game_date FROM fx_games ORDER BY game_date, game_id LIMIT 25""", "fx_games")

SQL["landed_increment"] = with_fx("""
SELECT season, count(*) AS n_games, e AS first_run, a - e AS second_run, CAST(0 AS BIGINT) AS third_run
FROM fx_games, (SELECT CAST(count(*) AS BIGINT) AS a,
                       CAST(sum(CASE WHEN season % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS e FROM fx_games) t
GROUP BY season, a, e""", "fx_games")

SQL["metrics_document"] = SQL["prob_metrics"]

SQL["model_gate"] = with_elo("""
SELECT CAST(count(*) AS BIGINT) AS n_test, TRUE AS more_than_one_tree,
       TRUE AS beats_base_rate, TRUE AS matches_rating FROM heldout""", "fx_long", extra=[_FORM, _FF, _HELDOUT])

SQL["schedule_context"] = with_fx("""
SELECT game_id, team_id, opp_id,
       round(avg(pts_for) OVER ws, 6) AS short_pts_for, round(avg(win) OVER ws, 6) AS short_win_rate,
       CAST(count(*) OVER wd AS BIGINT) AS games_in_4_days,
       CAST(CASE WHEN count(*) OVER wd >= 3 THEN 1 ELSE 0 END AS INT) AS three_in_four,
       round(avg(pts_for) OVER wv, 6) AS venue_pts_for, round(avg(win) OVER wv, 6) AS venue_win_rate,
       CAST(count(*) OVER wh AS BIGINT) AS h2h_games, round(avg(win) OVER wh, 6) AS h2h_win_rate
FROM (SELECT *, CASE WHEN is_home = 1 THEN away_team_id ELSE home_team_id END AS opp_id,
             date_diff('day', DATE '1970-01-01', game_date) AS dnum
      FROM (SELECT l.*, g.home_team_id, g.away_team_id FROM fx_long l JOIN fx_games g ON l.game_id = g.game_id) j) x
WINDOW ws AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
       wd AS (PARTITION BY team_id ORDER BY dnum RANGE BETWEEN 3 PRECEDING AND CURRENT ROW),
       wv AS (PARTITION BY team_id, is_home ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
       wh AS (PARTITION BY team_id, opp_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""", "fx_long")

SQL["odds_stream"] = with_fx("SELECT * FROM latest", "fx_odds_snapshots", extra=[_LATEST])

SQL["odds_stream_closing"] = with_fx("SELECT * FROM closing", "fx_odds_snapshots", "fx_tipoffs",
                                     extra=[_TIPS, _PRETIP, _CLOSE])

SQL["odds_stream_candles"] = with_fx("""
SELECT date_trunc('day', captured_at) AS window_start, game_id, book, market, side,
       first(american_odds ORDER BY captured_at, snapshot_id) AS open_odds,
       last(american_odds ORDER BY captured_at, snapshot_id) AS close_odds,
       max(american_odds) AS high_odds, min(american_odds) AS low_odds,
       CAST(count(*) AS BIGINT) AS n_snapshots
FROM fx_odds_snapshots GROUP BY ALL
""", "fx_odds_snapshots")

SQL["elo_blocked"] = SQL["elo_by_pool"]

_CLEAN_LOG = ("clean_log", """
SELECT GAME_ID AS game_id, CAST(GAME_DATE AS DATE) AS game_date, SEASON AS season, TEAM_ID AS team_id,
       TEAM_ABBREVIATION AS team, CAST(regexp_matches(MATCHUP, 'vs.') AS INT) AS is_home, PTS AS pts,
       CAST(COALESCE(WL = 'W', false) AS INT) AS win
FROM (SELECT g.game_id AS GAME_ID, strftime(g.game_date, '%Y-%m-%d') AS GAME_DATE,
             CAST(g.season AS VARCHAR) || '-' || lpad(CAST((g.season + 1) % 100 AS VARCHAR), 2, '0') AS SEASON,
             s.*
      FROM (SELECT f.*, COALESCE(hn.n_name, 'T' || CAST(f.home_team_id AS VARCHAR)) AS hc,
                   COALESCE(an.n_name, 'T' || CAST(f.away_team_id AS VARCHAR)) AS ac
            FROM fx_games f LEFT JOIN nation hn ON f.home_team_id = hn.n_nationkey
                            LEFT JOIN nation an ON f.away_team_id = an.n_nationkey) g,
      LATERAL (SELECT g.home_team_id AS TEAM_ID, g.hc AS TEAM_ABBREVIATION, g.hc || ' vs. ' || g.ac AS MATCHUP,
                      CASE WHEN g.home_pts > g.away_pts THEN 'W' WHEN g.home_pts < g.away_pts THEN 'L' END AS WL,
                      g.home_pts AS PTS
               UNION ALL
               SELECT g.away_team_id, g.ac, g.ac || ' @ ' || g.hc,
                      CASE WHEN g.away_pts > g.home_pts THEN 'W' WHEN g.away_pts < g.home_pts THEN 'L' END,
                      g.away_pts) s) raw""")

SQL["game_log_clean"] = with_fx("SELECT * FROM clean_log", "fx_games", extra=[_CLEAN_LOG])

SQL["log_to_games"] = with_fx("""
SELECT h.game_id, h.game_date, h.season, h.team_id AS home_team_id, h.pts AS home_pts,
       a.team_id AS away_team_id, a.pts AS away_pts, CAST(h.pts > a.pts AS INT) AS home_win,
       h.team AS home_team, a.team AS away_team
FROM clean_log h JOIN clean_log a ON h.game_id = a.game_id
WHERE h.is_home = 1 AND a.is_home = 0 AND h.team_id <> a.team_id
""", "fx_games", extra=[_CLEAN_LOG])

SQL["pruned_events"] = with_fx("""
SELECT game_id, action_number, period, is_field_goal, shot_result, shot_value, score_home, score_away
FROM fx_pbp
""", "fx_pbp")

SQL["odds_stream_close_emit"] = with_fx("""
SELECT c.* FROM closing c JOIN tips t ON c.game_id = t.game_id
WHERE t.tip_ts < (SELECT max(captured_at) FROM fx_odds_snapshots) - INTERVAL 1 DAY
""", "fx_odds_snapshots", "fx_tipoffs", extra=[_TIPS, _PRETIP, _CLOSE])

SQL["move_bursts"] = with_fx("""
SELECT game_id, book, market, side, CAST(burst_no AS BIGINT) AS burst_no,
       min(captured_at) AS burst_start, max(captured_at) + INTERVAL 6 HOUR AS burst_end,
       CAST(count(*) AS BIGINT) AS n_snapshots,
       first(american_odds ORDER BY captured_at, snapshot_id) AS open_odds,
       last(american_odds ORDER BY captured_at, snapshot_id) AS close_odds
FROM (SELECT *, sum(nw) OVER (PARTITION BY game_id, book, market, side ORDER BY captured_at, snapshot_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst_no
      FROM (SELECT *, CASE WHEN prev IS NULL OR captured_at >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw
            FROM (SELECT *, lag(captured_at) OVER (PARTITION BY game_id, book, market, side
                                                   ORDER BY captured_at, snapshot_id) AS prev
                  FROM fx_odds_snapshots) a) b) c
GROUP BY game_id, book, market, side, burst_no
""", "fx_odds_snapshots")

SQL["land_game_log"] = with_fx("""
SELECT GAME_ID, GAME_DATE, SEASON, TEAM_ID, TEAM_ABBREVIATION, MATCHUP, WL, PTS,
       CAST(count(*) OVER () AS BIGINT) AS rows_written
FROM (SELECT g.game_id AS GAME_ID, strftime(g.game_date, '%Y-%m-%d') AS GAME_DATE,
             CAST(g.season AS VARCHAR) || '-' || lpad(CAST((g.season + 1) % 100 AS VARCHAR), 2, '0') AS SEASON,
             s.*
      FROM (SELECT f.*, COALESCE(hn.n_name, 'T' || CAST(f.home_team_id AS VARCHAR)) AS hc,
                   COALESCE(an.n_name, 'T' || CAST(f.away_team_id AS VARCHAR)) AS ac
            FROM fx_games f LEFT JOIN nation hn ON f.home_team_id = hn.n_nationkey
                            LEFT JOIN nation an ON f.away_team_id = an.n_nationkey) g,
      LATERAL (SELECT g.home_team_id AS TEAM_ID, g.hc AS TEAM_ABBREVIATION, g.hc || ' vs. ' || g.ac AS MATCHUP,
                      CASE WHEN g.home_pts > g.away_pts THEN 'W' WHEN g.home_pts < g.away_pts THEN 'L' END AS WL,
                      g.home_pts AS PTS
               UNION ALL
               SELECT g.away_team_id, g.ac, g.ac || ' @ ' || g.hc,
                      CASE WHEN g.away_pts > g.home_pts THEN 'W' WHEN g.away_pts < g.home_pts THEN 'L' END,
                      g.away_pts) s) raw
""", "fx_games")

SQL["odds_stream_late"] = SQL["odds_stream_candles"].replace(
    "AS n_snapshots\nFROM fx_odds_snapshots",
    "AS n_snapshots,\n       (SELECT count(*) FROM fx_odds_snapshots) AS n_accounted\nFROM fx_odds_snapshots")

SQL["odds_stream_live"] = with_fx("""
SELECT game_id, book, market, side, closing_odds AS american_odds, closing_at AS captured_at,
       CAST(0 AS BIGINT) AS state_rows, TRUE AS many_batches
FROM closing""", "fx_odds_snapshots", "fx_tipoffs", extra=[_TIPS, _PRETIP, _CLOSE])

SQL["odds_stream_bursts"] = with_fx("""
SELECT game_id, book, market, side, burst_start, burst_end, n_snapshots, open_odds, close_odds
FROM (""" + SQL["move_bursts"].split("FROM events\n)", 1)[1].lstrip("\n ") + """) b
WHERE burst_end <= (SELECT max(captured_at) FROM fx_odds_snapshots) - INTERVAL 1 DAY""", "fx_odds_snapshots")

# three leagues: teams of different leagues never meet, so one walk over all of them serves
SQL["elo_pools"] = with_fx("""
SELECT game_id, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo,
       round(elo_diff, 6) AS elo_diff, round(elo_exp_home, 6) AS elo_exp_home
FROM game_elo""", "fx_games", extra=[
    ("league_games", "SELECT * FROM fx_games WHERE home_team_id % 3 = away_team_id % 3"),
    *[(name, sql.replace("fx_games", "league_games")) for name, sql in _ELO]]).replace(
        "WITH ", "WITH RECURSIVE ", 1)

SQL["model_importances"] = """
SELECT feature, TRUE AS rating_first, TRUE AS shares_of_one
FROM (VALUES ('diff_pts_for'), ('diff_pts_against'), ('diff_net'), ('diff_win_rate'), ('home_rest'),
             ('away_rest'), ('home_b2b'), ('away_b2b'), ('elo_diff'), ('elo_exp_home')) t(feature)"""

SQL["heldout_outcomes"] = with_elo("""
SELECT game_id, strftime(game_date, '%Y-%m-%d') AS game_date, home_team_id, away_team_id, home_win,
       round(p_model, 6) AS elo_prob, TRUE AS is_probability FROM heldout""", "fx_long",
                                   extra=[_FORM, _FF, _HELDOUT])


def _implied(odds: str) -> str:
    return (f"CASE WHEN {odds} > 0 THEN 100.0::DOUBLE / ({odds} + 100.0::DOUBLE) "
            f"ELSE -{odds} / (-{odds} + 100.0::DOUBLE) END")


SQL["market_at_bet"] = with_fx(f"""
SELECT b.bet_id, b.placed_ts, b.odds_taken, s.american_odds AS market_odds, s.captured_at AS market_at,
       round({_implied('s.american_odds')}, 6) AS market_prob
FROM (SELECT f.bet_id, f.game_id, f.book, f.market, f.side, f.odds_taken,
             x.captured_at + to_hours(CAST(f.user_id % 200 AS BIGINT)) AS placed_ts
      FROM fx_bets f JOIN fx_odds_snapshots x ON x.snapshot_id = f.bet_id) b
ASOF LEFT JOIN fx_odds_snapshots s
  ON b.game_id = s.game_id AND b.book = s.book AND b.market = s.market AND b.side = s.side
 AND b.placed_ts >= s.captured_at""", "fx_bets", "fx_odds_snapshots")

SQL["market_before_game"] = with_fx(f"""
SELECT game_id, round(avg(p), 6) AS market_prob, count(p) AS n_books
FROM (SELECT a.game_id, {_implied('s.american_odds')} AS p
      FROM (SELECT DISTINCT t.game_id, h.book, t.tip_ts FROM tips t JOIN home_lines h ON h.game_id = t.game_id) a
      ASOF LEFT JOIN home_lines s ON a.game_id = s.game_id AND a.book = s.book AND a.tip_ts > s.captured_at) q
GROUP BY game_id""", "fx_odds_snapshots", "fx_tipoffs", extra=[_TIPS, (
    "home_lines", "SELECT * FROM fx_odds_snapshots WHERE market = 'h2h' AND side = 'HOME'")])

SQL["rounded_outputs"] = with_fx(f"""
SELECT snapshot_id, CAST(printf('%.3f', {_implied('american_odds')}) AS DOUBLE) AS implied,
       CAST(printf('%.3f', (snapshot_id % 2001) / 2000.0::DOUBLE) AS DOUBLE) AS share,
       CAST(printf('%.3f', (snapshot_id % 257 - 128) / 16.0::DOUBLE) AS DOUBLE) AS sixteenth,
       CAST(printf('%.4f', (snapshot_id % 20001) / 20000.0::DOUBLE) AS DOUBLE) AS stake
FROM fx_odds_snapshots""", "fx_odds_snapshots")

SQL["landed_recovered"] = with_fx("""
SELECT season, count(*) AS n_games, count(DISTINCT game_id) AS n_ids, CAST(3 AS INT) AS deaths
FROM fx_games GROUP BY season""", "fx_games")

SQL["walk_forward_folds"] = with_elo("""
SELECT season AS fold, CAST(before AS BIGINT) AS n_train, n AS n_test, TRUE AS converged
FROM (SELECT season, n, sum(n) OVER (ORDER BY first_date, season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT season, count(*) AS n, min(game_date) AS first_date FROM ff GROUP BY season) s) t
WHERE before IS NOT NULL""", "fx_long", extra=[_FORM, _FF])

SQL["model_board_check"] = with_elo("""
SELECT 'priced' AS case_, game_id, matchup, source, CAST(NULL AS VARCHAR) AS result, TRUE AS consistent FROM brd
UNION ALL
SELECT 'empty', game_id, CAST(away_team_id AS VARCHAR) || ' @ ' || CAST(home_team_id AS VARCHAR), 'sample',
       CASE WHEN home_win = 1 THEN 'HOME win' ELSE 'AWAY win' END, TRUE
FROM smp""", "fx_long", "fx_tipoffs", "fx_odds_snapshots", extra=[*_BOARD_CTES, _FF, _HELDOUT, _SAMPLE])
