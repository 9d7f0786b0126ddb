"""The final SELECT of every registered query."""

from __future__ import annotations

from oracles.sql import CTES, clean, emp, iso, loc, rnd, statement

DAY = "cast({} as varchar)".format

# Streaks of the audited period alone: days cut to the period, carried from the period before.
_carry = {
    "inside": CTES["pieces"].replace(
        "from punches\nunion all",
        "from punches where cast(in_punch as date) between date '2024-01-07' and date '2024-01-20'\nunion all",
    ).replace(
        "where cast(in_punch as date) <> cast(out_punch as date)",
        "where cast(in_punch as date) <> cast(out_punch as date) "
        "and cast(in_punch as date) between date '2024-01-07' and date '2024-01-20'",
    ),
    "earlier": CTES["pieces"].replace(
        "from punches\nunion all",
        "from punches where cast(in_punch as date) < date '2024-01-07'\nunion all",
    ).replace(
        "where cast(in_punch as date) <> cast(out_punch as date)",
        "where cast(in_punch as date) <> cast(out_punch as date) and cast(in_punch as date) < date '2024-01-07'",
    ),
}
for _name in ("earlier", "inside"):
    CTES[f"{_name}_pieces"] = _carry[_name]
    CTES[f"{_name}_days"] = CTES["days"].replace("from pieces", f"from {_name}_pieces")
# Runs of the prior period up to its last day, counted back day by day over distinct rows.
CTES["islands"] = """
select id, workday, location, workday - (dense_rank() over (partition by id order by workday))::int as island
from earlier_days"""
CTES["carried"] = """
select l.id, max(c.streak) as carried from (
  select id, island, count(*) as streak from islands
    where location = 'CCC' and workday <= date '2024-01-06' group by id, island) c
join islands l on l.id = c.id and l.island = c.island and l.workday = date '2024-01-06' group by l.id"""
CTES["inside_walk"] = """
select d.id, d.n, d.workday, d.location = 'CCC' as rolling,
  case when d.location = 'CCC' and d.workday = date '2024-01-07' then coalesce(c.carried, 0) + 1 else 1 end as streak
from inside_days d left join carried c using (id) where n = 1
union all
select d.id, d.n, d.workday, w.rolling,
  case when d.workday - w.workday > 1 then 1
    when not w.rolling and isodow(w.workday) <> 7 and isodow(d.workday) = 7 then 1 else w.streak + 1 end
from inside_walk w join inside_days d on d.id = w.id and d.n = w.n + 1"""
CTES["inside_premium"] = (
    CTES["premium"].replace("join walk", "join inside_walk").replace("from days", "from inside_days")
    .replace("w.started, ", "")
)
CTES["inside_rows"] = CTES["week_rows"].replace("from premium", "from inside_premium")
CTES["inside_spill"] = (
    CTES["spill"].replace("from spill", "from inside_spill").replace("week_rows", "inside_rows")
)

PUNCH = {
    "punch_helpers": f"""{iso('prev_in')} as prev_in, {iso('prev_out')} as prev_out, {iso('next_in')} as next_in,
      {iso('next_out')} as next_out, {DAY('prev_date')} as prev_date, {DAY('next_date')} as next_date,
      len_min / 60 as raw_hours, prev_len / 60 as prev_hours, next_len / 60 as next_hours, break_min, next_break_min""",
    "shift_sessions": "new_shift, shift_no::bigint as shift_no, shift_hours",
    "shift_breaks": f"""{iso('shift_start')} as shift_start, new_shift as first_of_shift, is_break,
      break_count::bigint as break_count, break_order::double as break_order""",
    "second_break": f"{iso('second_break_start')} as second_break_start, hours_to_second as hours_to_second_break",
    "twelve_hour_credit": "shift_hours, break_count::bigint as break_count, twelve as twelve_hour_credit",
    "stapled_punches": "is_new_punch, punch_no::bigint as punch_no, punch_hours",
    "split_shift_dollars": "rate_paid, split_paid, split_min as split_at_min, split_min - split_paid as split_due",
    "waiver_lookup": "has_waiver",
    "register_lookup": f"paid_break as paid_break_hours, {iso('hired')} as hire_date",
}
DAILY_ALL = {
    "workweek_id": f"location, {DAY('workday')} as workday, {DAY('workweek')} as workweek",
    "consecutive_streaks": f"""location, {DAY('workday')} as workday, streak as days_worked,
      {DAY('started')} as streak_start""",
    "weekly_spillover": f"""location, {DAY('workday')} as workday, hours_worked, regular_hours, ot_hours, dt_hours,
      cum_regular as cum_regular_hours, spillover as weekly_spillover""",
}
DAILY = {
    "consecutive_premium": f"""location, {DAY('workday')} as workday, flagged as consecutive_rule,
      {DAY('first_day')} as first_day_of_streak, consec_ot, consec_dt""",
    "ta_vs_register": f"""location, {DAY('workday')} as workday, ot_period, ot_paid, ot_var as ot_variance,
      dt_period, dt_paid, dt_var as dt_variance""",
    "daily_flags": f"""location, {DAY('workday')} as workday, first_of_id as is_first,
      coalesce(ot_period = 0 and ot_paid = 0 and dt_period = 0 and dt_paid = 0, false) as is_zero,
      coalesce(abs(ot_var) >= 0.01, false) as is_ot_variance, coalesce(abs(dt_var) >= 0.01, false) as is_dt_variance,
      consec_ot > 0 as is_consecutive""",
}
REGISTER = {
    "rrop": ("rates", "base_rate, non_disc, total_nd, per_hour, half, rrop"),
    "due_overtime": ("due_ot", "due, paid, variance"),
    "due_doubletime": ("due_dt", "due, paid, variance"),
    "due_break": ("due_break", "due, paid, variance, ratio"),
    "due_rest": ("due_rest", "due, paid, variance, ratio"),
    "due_sick": ("due_sick", "due, paid, variance, ratio"),
    "min_wage": ("wages", "min_wage, min_40, min_check"),
    "flsa": (
        "reg",
        "rate_paid, case when rate_paid < 100 and flsa = 'E' then 'CHECK' else '' end as flsa_check",
    ),
    "non_active": (
        "reg",
        "pos as position, case when hn > 0 and pos in ('Terminated', 'Leave') then 'CHECK' else '' end as non_active",
    ),
}


def finite(x: str) -> str:
    return f"(case when isinf({x}) then null else {x} end)"


def credit_report(source: str, hours: str, names: tuple[str, str, str, str, str, str]) -> str:
    h, d, paid, var, ratio, rate = names
    return f"""select id as "IDX", name as "Payroll Name", {hours} as "{h}", {finite('due')} as "{d}",
      {finite('paid')} as "{paid}", {finite('variance')} as "{var}", {finite('ratio')} as "{ratio}",
      rate_paid as "{rate}"
    from {source} where abs(variance) > 0.01 order by name, id"""


_PUNCH_ORDER = "order by employee, id, in_punch, out_punch, seq"
_DAILY_ORDER = "order by employee, id, workday, location"

REPORTS = {
    "overtime_checks_variances": f"""select id as "IDX", name as "Payroll Name", {finite('due')} as "1.5 OT Earnings Due ($)",
      paid as "Actual Pay Check ($)", {finite('variance')} as "Variance ($)"
      from due_ot where abs(variance) > 0.01 order by name, id""",
    "doubletime_checks_variances": f"""select id as "IDX", name as "Payroll Name", {finite('due')} as "Double Time Due ($)",
      paid as "Actual Pay Check Dble", {finite('variance')} as "Variance Dble ($)"
      from due_dt where abs(variance) > 0.01 order by name, id""",
    "break_credit_variances": credit_report(
        "due_break",
        "brk_hours",
        (
            "Break Credit Hours",
            "Break Credit Due",
            "Actual Paid Break Credit",
            "Variance Break Credit",
            "Break Credit Due / Break Credit Hours",
            "Regular Rate Paid",
        ),
    ),
    "rest_credit_variances": credit_report(
        "due_rest",
        "rest_hours",
        (
            "Rest Credit Hours",
            "Rest Credit Due",
            "Actual Paid Rest Credit ($)",
            "Variance Rest Credit ($)",
            "Rest Credit Due / Rest Credit Hours",
            "Regular Rate Paid",
        ),
    ),
    "sick_credit_variances": credit_report(
        "due_sick",
        "sick_hours",
        (
            "Sick Credit Hours",
            "Sick Credit Due ($)",
            "Actual Paid Sick Credit ($)",
            "Variance Sick Credit ($)",
            "Sick Credit Due / Sick Credit Hours",
            "Regular Rate Paid ($)",
        ),
    ),
    "flsa_check": """select id as "IDX", name as "Payroll Name", pos as "Position Status", flsa as "FLSA Status",
      rate_paid as "Regular Rate Paid" from reg where rate_paid < 100 and flsa = 'E' order by name, id""",
    "min_wage_check": f"""select id as "IDX", name as "Payroll Name", pos as "Position Status", flsa as "FLSA Status",
      hn as "Regular Hours", {finite('base_rate')} as "Base Rate", rate_paid as "Regular Rate Paid",
      sick_earn as "Sick Pay Earnings", vac_earn as "Vacation Earnings"
      from wages where min_check = 'CHECK' and hn > 0 order by name, id""",
    "non_active_check": f"""select id as "IDX", name as "Payroll Name", pos as "Position Status", job as "Job Description",
      {iso('hired')} as "Hire Date", vac_hours as "Vacation Hours", {iso('ended')} as "Termination Date",
      hn as "Straight Hours Worked" from reg where hn > 0 and pos in ('Terminated', 'Leave') order by name, id""",
    "break_credit_summary": """select id as "ID", employee as "Employee", paid as "Paid Break Credit (hrs)",
      due as "Due Break Credit (hrs)", variance as "Variance", sb as "Short Break", nb as "Did Not Break",
      fm as "First Meal Break", ot as "Over Twelve"
      from summary where variance is distinct from 0 order by paid desc nulls last, id""",
    "short_break_earned_credits": f"""select employee as "Employee", id as "ID", {iso('prev_in')} as "Prev In Punch",
      {iso('prev_out')} as "Prev Out Punch", break_min as "Break Time (min)", {iso('in_punch')} as "In Punch",
      punch_hours as "Punch Length (hrs)", paid_break as "Paid Break Credit (hrs)", shift_hours as "Hours Worked Shift"
      from marks where short_break {_PUNCH_ORDER}""",
    "did_not_break_meal_waiver_check": f"""select id as "ID", employee as "Employee", {iso('hired')} as "Hire Date",
      {iso('in_punch')} as "In Punch", {iso('out_punch')} as "Out Punch", punch_hours as "Punch Length (hrs)",
      shift_hours as "Hours Worked Shift", paid_break as "Paid Break Credit (hrs)", has_waiver as "Waiver on File?"
      from marks where no_break {_PUNCH_ORDER}""",
    "seven_consecutive": f"""select employee as "Employee", id as "ID", {DAY('workday')} as "Trigger Date",
      {DAY('first_day')} as "First_Day_of_Streak", consec_ot as "Consec_OT_Hours", consec_dt as "Consec_DT_Hours"
      from audited where consec_ot > 0 {_DAILY_ORDER}""",
    "ot_vs_wfn": f"""select employee as "Employee", id as "ID", ot_period as "OT_Hours_Pay_Period",
      ot_paid as "OT_Hours_Paid", ot_var as "OT_Variance_(hrs)" from audited where first_of_id and
      not coalesce(ot_period = 0 and ot_paid = 0 and dt_period = 0 and dt_paid = 0, false) and abs(ot_var) >= 0.01 {_DAILY_ORDER}""",
    "dt_vs_wfn": f"""select employee as "Employee", id as "ID", dt_period as "DT_Hours_Pay_Period",
      dt_paid as "DT_Hours_Paid", dt_var as "DT_Variance_(hrs)" from audited where first_of_id and
      not coalesce(ot_period = 0 and ot_paid = 0 and dt_period = 0 and dt_paid = 0, false) and abs(dt_var) >= 0.01 {_DAILY_ORDER}""",
    "split_shift": f"""select employee as "Employee", id as "ID", {iso('prev_out')} as "Prev Out Punch",
      {iso('in_punch')} as "In Punch", break_min as "Break Time (min)", rate_paid as "Straight Rate ($)",
      split_paid as "Split Paid ($)", split_min as "Split at Min Wage ($)", split_min - split_paid as "Split Shift Due ($)"
      from marks where split {_PUNCH_ORDER}""",
    "short_shift": f"""select employee as "Employee", id as "ID", break_min as "Break Time (min)",
      {iso('in_punch')} as "In Punch", {iso('out_punch')} as "Out Punch", punch_hours as "Punch Length (hrs)",
      shift_hours as "Hours Worked Shift" from marks where short_shift {_PUNCH_ORDER}""",
}

_H = "{} / 60".format
LEGACY_WEEK = f"""
with limits as (
  select f.*, case location when 'BBB' then 450 else 480 end as ot_max,
    cast(floor((work_date - date '2024-01-07') / 7) as bigint) + 1 as wk,
    row_number() over (partition by id, work_date order by rn) = 1 as first_day,
    row_number() over (partition by id, cast(floor((work_date - date '2024-01-07') / 7) as bigint) order by rn) = 1 as first_week
  from facts f),
d as (select id, work_date, sum(len_min) as day_min from limits group by all),
t as (select id, sum(len_min) as all_min from limits group by all),
one as (select l.id, l.wk, l.rn, greatest(least(day_min, 720) - ot_max, 0) as day_ot, greatest(day_min - 720, 0) as day_dt
  from limits l join d using (id, work_date) where first_day),
w as (select id, wk, sum(day_ot) as sum_ot, sum(day_dt) as sum_dt from one group by all),
g as (select id, wk, sum(len_min) as week_min from limits group by all),
n as (select l.*, day_min, all_min, week_min, sum_ot, sum_dt,
    greatest(least(day_min, 720) - ot_max, 0) as day_ot, greatest(day_min - 720, 0) as day_dt,
    greatest(0, week_min - 2400) as gross, greatest(0, greatest(0, week_min - 2400) - sum_ot - sum_dt) as net,
    cast(shift_start as date) between date '2024-01-07' and date '2024-01-20' as inside
  from limits l join d using (id, work_date) join t using (id) join w using (id, wk) join g using (id, wk)),
p as (select id, sum(case when inside then sum_ot + net else 0 end) as p_ot, sum(case when inside then sum_dt else 0 end) as p_dt
  from n where first_week group by id)
select n.id, seq, cast(work_date as varchar) as work_date, wk as work_week, {rnd(_H('day_min'), 6)} as workday_hours,
  {rnd(_H('week_min'), 6)} as week_hours, {rnd(_H('all_min'), 6)} as total_hours_period, {rnd(_H('day_ot'), 6)} as workday_ot_hours,
  {rnd(_H('day_dt'), 6)} as workday_dt_hours, {rnd(_H('gross'), 6)} as week_ot_gross, {rnd(_H('net'), 6)} as week_ot_net,
  {rnd(_H('(sum_ot + net)'), 6)} as total_ot_week, {rnd(_H('sum_dt'), 6)} as total_dt_week,
  {rnd(_H('(case when inside then sum_ot + net else 0 end)'), 6)} as adjusted_ot_week,
  {rnd(_H('(case when inside then sum_dt else 0 end)'), 6)} as adjusted_dt_week,
  {rnd(_H('p_ot'), 4)} as total_ot_period, {rnd(_H('p_dt'), 4)} as total_dt_period
from n join p on p.id = n.id"""

CTES["run_rows"] = """
select n.id, n.seq, n.rn, n.work_date, n.len_min,
  sum(case when b.work_date is null or n.work_date - b.work_date <> 1 then 1 else 0 end) over (partition by n.id order by n.rn) as run
from numbered n left join numbered b on b.id = n.id and b.rn = n.rn - 1"""
LEGACY_ROLLING = f"""
select r.id, r.seq, cast(r.work_date as varchar) as work_date,
  case when count(q.rn) = 7 then {rnd('sum(q.len_min) / 60', 4)} else 0::double end as consecutive_hours,
  cast(r.work_date - 6 as varchar) as streak_shown_from
from run_rows r join run_rows q on q.id = r.id and q.run = r.run and q.rn between r.rn - 6 and r.rn
group by r.id, r.seq, r.rn, r.work_date"""

_OUTSIDE = "cast(in_punch as date) not between date '2024-01-07' and date '2024-01-20'"

OTHER = {
    "punch_flags": """select id, seq, short_break as is_short_break, first_meal as is_first_meal_break,
      has_waiver as is_waiver_on_file, split as is_split_shift, no_break as is_did_not_break,
      no_break_any as is_did_not_break_any, short_shift as is_short_shift, same_date as is_same_date,
      over_twelve as is_over_twelve, first_of_day as is_first_of_day from marks""",
    "anomaly_rollup": """select id, employee, paid as paid_break_hours, sb as short_break, nb as did_not_break,
      fm as first_meal_break, ot as over_twelve, due as due_break_hours, variance from summary""",
    "daily_midnight_split": f"""select id, employee, location, cast(workday as varchar) as workday,
      {rnd('sum(m) / 60', 4)} as hours_worked from pieces group by id, employee, location, workday""",
    "daily_ot_dt": f"""select id, location, cast(workday as varchar) as workday, {rnd('reg0 / 60', 4)} as regular_hours,
      {rnd('ot0 / 60', 4)} as ot_hours, {rnd('dt0 / 60', 4)} as dt_hours from days""",
    "fiscal_pay_date": """select cast(d as varchar) as workday, cast(case when d < date '2024-01-07' then date '2024-01-12'
      when d <= date '2024-01-20' then date '2024-01-26' else date '2024-02-09' end as varchar) as fiscal_pay_date,
      count(*) as punches from (select cast(in_punch as date) as d from punches) group by d""",
    "pay_period_totals": """select id, location, cast(workday as varchar) as workday, cast(fiscal as varchar) as fiscal_pay_date,
      ot_period, dt_period from daily join totals using (id, employee, fiscal)""",
    "carryover_streaks": f"""select p.id, cast(p.workday as varchar) as workday, streak as days_worked,
      {rnd('(reg1 - over) / 60', 4)} as regular_hours, {rnd('(ot1 + over) / 60', 4)} as ot_hours, {rnd('dt1 / 60', 4)} as dt_hours
      from inside_premium p join inside_spill s using (id, n) where p.fiscal = date '2024-01-26'""",
    "register_flags": """select o.id, coalesce(abs(o.variance) > 0.01, false) as is_variance,
      coalesce(abs(d.variance) > 0.01, false) as is_variance_dble, coalesce(abs(b.variance) > 0.01, false) as is_variance_brkcrd,
      coalesce(abs(r.variance) > 0.01, false) as is_variance_restcrd, coalesce(abs(s.variance) > 0.01, false) as is_variance_sick,
      o.rate_paid < 100 and o.flsa = 'E' as is_flsa, min_check = 'CHECK' and o.hn > 0 as is_min_wage,
      o.hn > 0 and o.pos in ('Terminated', 'Leave') as is_non_active
      from due_ot o join due_dt d using (k) join due_break b using (k) join due_rest r using (k) join due_sick s using (k)
      join wages w using (k)""",
    "intake_outliers": f"""select cast(cast(in_punch as date) as varchar) as punch_day, count(*) as punches
      from punches where {_OUTSIDE} group by cast(in_punch as date)""",
    "intake_check": f"""select 'STRAGGLER_WARNING' as error_type, '2024-01-07' as first_day, '2024-01-20' as last_day,
      (select cast(min(cast(in_punch as date)) as varchar) from punches) as file_first,
      (select cast(max(cast(in_punch as date)) as varchar) from punches) as file_last,
      (select count(*) from punches where {_OUTSIDE}) as outliers,
      (select string_agg(cast(d as varchar), ', ' order by d) from
        (select distinct cast(in_punch as date) as d from punches where {_OUTSIDE} order by d limit 5)) as days,
      (select string_agg(seq || ':' || id, ', ' order by seq) from
        (select seq, id from punches where {_OUTSIDE} order by seq limit 4)) as samples""",
    "register_date_mismatch": f"""with bad as (select c_custkey as k, {emp('c_custkey')} as id from customer
        where c_custkey % 97 = 5 or c_custkey % 101 = 7)
      select count(*) as employees, (select string_agg(id || ':' || (case when k % 97 = 5 then '2024-01-12' else 'missing' end),
        ', ' order by k) from (select * from bad order by k limit 5)) as samples from bad having count(*) > 0""",
    "duplicate_keys": 'select id, count(*) as "rows" from waiver_rows group by id having count(*) > 1',
    "duplicate_punches": f"""select id, {iso("date_trunc('hour', in_punch)")} as in_punch, count(*) as "rows"
      from punches group by id, date_trunc('hour', in_punch) having count(*) > 1""",
    "map_concat_substring": f"""select id, location, reg, job, substr(id, 1, 3) as head, right(id, 4) as tail,
      substr(id, 3, length(id) - 4) as inner from (select {loc('c_custkey')} || '0' ||
        (case when length(cast(c_custkey as varchar)) < 6 then lpad(cast(c_custkey as varchar), 6, '0') else cast(c_custkey as varchar) end) as id,
        {loc('c_custkey')} as location, c_acctbal as reg, c_mktsegment as job from customer)""",
    "drop_rows": """select event_id from events where value > 5 and event_type is not null
      and event_type not in ('view', 'error') and user_id is distinct from 7""",
    "location_override": """select location, count(*) as punches, case location when 'CCC' then 18::double else 17.25::double end as min_wage,
      case location when 'BBB' then 7.5::double else 8::double end as ot_day_max,
      case location when 'BBB' then 90::double else 60::double end as gap, location = 'CCC' as rolling,
      16.5::double as state_min_wage from punches group by location""",
    "punch_query": f"""select id as "ID", {iso('in_punch')} as "In Punch", {iso('out_punch')} as "Out Punch", employee as "Employee",
      shift_no::bigint as "Shift Number", is_break as "Is Break?" from facts where work_date between date '2024-01-07' and date '2024-01-20'
      order by in_punch, id, out_punch""",
    "daily_query": """select id as "ID", location as "Location", cast(workday as varchar) as "Attributed_Workday",
      hours_worked as "Hours_Worked", regular_hours as "Regular_Hrs", ot_hours as "OT_Hrs", dt_hours as "DT_Hrs"
      from audited where workday between date '2024-01-08' and date '2024-01-14'""",
    "upsert_result": f"""select id as "ID", {iso('in_punch')} as "In Punch",
      case when cast(in_punch as date) > date '2024-01-20' then 'Amended' else 'Approved' end as "Status",
      case when cast(in_punch as date) > date '2024-01-20' then '2024-02-09' else '2024-01-26' end as pay_date from punches""",
    "outer_merge_fill": """select coalesce(e.user_id, c.c_custkey) as key, coalesce(n, 0) as punches, c_name as name,
      coalesce(c_nationkey, 0)::int as nation from (select user_id, count(*) as n from events where user_id is not null
        group by user_id) e full outer join customer c on c.c_custkey = e.user_id""",
    "file_neighbours": """select p.seq, p.id, (select arg_max(b.id, b.seq) from punches b where b.seq < p.seq
        and b.seq >= p.seq - 1000) as prev_id,
      (select arg_min(a.id, a.seq) from punches a where a.seq > p.seq and a.seq <= p.seq + 1000) as next_id from punches p""",
    "intake_punches": f"""with e as (select user_id as u, event_id as e, date_trunc('minute', ts) as tin from events
        where user_id is not null and event_id is not null and event_id % 50 <> 3),
      p as (select u, e, {iso('tin')} as in_punch, {iso("tin + to_minutes(cast(30 + e % 571 as integer))")} as out_punch from e)
      select 'AAA' || lpad(cast(u as varchar), 7, '0') as id, ' AA' as location, 'Doe, ' || u as employee, in_punch, out_punch,
        'ok' as status from p where u % 2 = 0
      union all select 'BBB0' || lpad(cast(u as varchar), 6, '0'), 'BBB', 'W' || u, in_punch, out_punch, 'ok' from p
        where u % 2 = 1 and u % 10 <> 1 and e % 20 <> 7""",
    "intake_register": """select 'AAA0' || lpad(cast(c_custkey as varchar), 6, '0') as id, c_name || ', X' as name,
      case when c_custkey % 9 <> 4 then '2024-01-26T00:00:00' end as paid_on, (c_custkey % 80)::double as hours,
      case when c_custkey % 3 <> 0 then (c_custkey % 7)::double end as ot, 'AAA' as location from customer""",
    "intake_waivers": """select cast(c_custkey // 2 as varchar) as id, arg_min(c_custkey % 3 = 0, c_custkey) as has_waiver
      from customer group by c_custkey // 2""",
    "intake_rejected": """select c_custkey + 1 as line, case when c_custkey % 7 = 2 then 'open quote'
        when c_custkey % 7 = 3 then 'surplus cells' else 'kept' end as fate from customer""",
    "intake_multiline": """select case when c_custkey % 13 <> 7 then 'AAA0' || lpad(cast(c_custkey as varchar), 6, '0')
        else cast(c_custkey as varchar) end as id,
      case when c_custkey % 13 = 7 then 'open quote' when c_custkey % 5 = 0 then c_name || chr(10) || chr(10) || 'says "no", twice'
        when c_custkey % 5 = 1 then c_name || ',' || chr(10) || '","' else c_name
      end as name, case when c_custkey % 13 <> 7 then (c_custkey % 80)::double end as hours from customer""",
    "rejected_periods": """select distinct case when seq % 4 = 2 then 'other' else 'demo' end as client_id,
        case seq % 4 when 1 then '2024-01-25' when 3 then '2024-01-12' else '2024-01-26' end as pay_date,
        case when seq % 4 = 0 then 'STRAGGLER_WARNING' else 'HARD_ERROR' end as error_type from punches""",
    "save_punches": f"""select id as "ID", {iso('in_punch')} as "In Punch", {iso('out_punch')} as "Out Punch", employee as "Employee",
      shift_no::bigint as "Shift Number", is_break as "Is Break?", '2024-01-26' as pay_date from facts""",
    "save_daily": """select id as "ID", location as "Location", cast(workday as varchar) as "Attributed_Workday",
      hours_worked as "Hours_Worked", regular_hours as "Regular_Hrs", ot_hours as "OT_Hrs", dt_hours as "DT_Hrs",
      '2024-01-26' as pay_date from audited""",
    "delete_period": f"""select id as "ID", {iso('in_punch')} as "In Punch", '2024-01-26' as pay_date from punches
      where cast(in_punch as date) <= date '2024-01-20'""",
    "raw_copy": f"""select {emp('c_custkey')} as id, c_name as name, {loc('c_custkey')} as location,
      coalesce((select sum(l_quantity) from orders join lineitem on l_orderkey = o_orderkey
        where o_custkey = c_custkey and l_returnflag = 'N'), 0)::double as hours from customer""",
    "raw_waivers": """with filed as (select cast(c_custkey as varchar) as "ID",
        case when c_custkey % 3 = 0 then 'x' else 'no, "' || c_name || '"' || chr(10) end as "Check",
        case when c_custkey % 2 = 0 then '2024-01-26' else '2024-02-09' end as filed from customer)
      select copy, "ID", "Check", filed from filed, (values ('waivers'), ('waivers_json')) t(copy) union all
      select copy, "ID", "Check", null from filed, (values ('waivers_of_client'), ('waivers_of_client_json')) t(copy)
        where cast("ID" as int) % 5 = 0""",
    "employee_punches": f"""select id as "ID", {iso('in_punch')} as "In Punch", {iso('out_punch')} as "Out Punch",
      shift_no::bigint as "Shift Number" from facts where id = 'AAA0000003'
      and cast(in_punch as date) between date '2024-01-07' and date '2024-01-20'""",
    "employee_daily": """select id as "ID", cast(workday as varchar) as "Attributed_Workday", hours_worked as "Hours_Worked",
      regular_hours as "Regular_Hrs", ot_hours as "OT_Hrs" from audited where id = 'AAA0000003'""",
    "changed_streaks": """select id, '2024-01-26' as pay_date, streak::bigint as recorded, null::bigint as current from daily
      where workday = date '2024-01-06' and location = 'CCC' and cast(right(id, 1) as int) % 2 = 0""",
    "stored_report": REPORTS["overtime_checks_variances"],
    "run_metadata": """select '2024-01-26' as pay_date, '2024-01-07' as first_date, '2024-01-20' as last_date,
      (select count(*) from punches) as ta_rows, (select count(*) from customer) as wfn_rows, 0::bigint as waiver_rows""",
    "rules_documents": """select c_custkey as id, case when c_custkey % 2 = 0 then 30 + c_nationkey else 60 end::double as gap,
      case when c_nationkey % 2 = 1 then 18.5 else 17.25 end::double as wage, (8 + c_nationkey % 3)::double as ot_day,
      14 as length from customer""",
    "skipped_checks": """select id, variance, 0 as computed,
      'non_active_check: Missing Hire Date; sick_credit_variances: Missing Sick Pay Hours' as skipped from due_ot""",
    "absent_lookup": "select id, seq, paid_break as paid, null::double as absent from facts",
    "report_top_rows": REPORTS["short_shift"] + " limit 200",
    "run_counts": """select 'ta_rows' as name, count(*) as "rows" from punches union all
      select 'wfn_rows', count(*) from customer union all select 'waiver_rows', count(*) from waivers union all
      select 'anomalies_rows', count(*) from summary""",
    "json_report": """select id as "ID", cast(workday as varchar) as "Trigger Date",
      '{"Employee":"' || employee || '","First_Day_of_Streak":"' || first_day || '","Consec_OT_Hours":' || consec_ot ||
      ',"Consec_DT_Hours":' || consec_dt || '}' as row from audited where consec_ot > 0
      order by employee, id, workday, location""",
}


def all_statements() -> dict[str, str]:
    out = {n: f"select id, seq, {cols} from facts" for n, cols in PUNCH.items()}
    out.update({n: f"select id, {cols} from daily" for n, cols in DAILY_ALL.items()})
    out.update({n: f"select id, {cols} from audited" for n, cols in DAILY.items()})
    out.update({n: f"select id, {cols} from {src}" for n, (src, cols) in REGISTER.items()})
    out.update({f"report_{n}": sql for n, sql in REPORTS.items()})
    out.update(OTHER)
    out["legacy_rolling_days"] = LEGACY_ROLLING
    result = {n: statement(sql) for n, sql in out.items()}
    result["legacy_weekly_ot"] = statement(LEGACY_WEEK.strip().removeprefix("with "), joined=True)
    return result
