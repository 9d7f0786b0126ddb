"""DuckDB statements that answer each registered query independently of the Spark plans.

Neighbours come from self-joins on row numbers, streaks from islands of (date - row number) and a
recursive walk, weekly spillover from a recursive walk. Durations are whole minutes, which the
sample punches are made of.
"""

from __future__ import annotations

import re


def rnd(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0::double)"


def div(n: str, d: str) -> str:
    n, d = f"({n})::double", f"({d})::double"
    return (
        f"(case when {d} = 0 then case when {n} > 0 then 'infinity'::double "
        f"when {n} < 0 then '-infinity'::double end else {n} / {d} end)"
    )


def clean(x: str) -> str:
    """NaN becomes NULL."""
    return f"(case when isnan({x}) then null else {x} end)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def loc(k: str) -> str:
    return f"(case {k} % 3 when 0 then 'AAA' when 1 then 'BBB' else 'CCC' end)"


def emp(k: str) -> str:
    return f"({loc(k)} || '0' || lpad(cast({k} as varchar), 6, '0'))"


def every(n: int, value: str) -> str:
    return f"(case when k % {n} = 0 then ({value})::double else 0::double end)"


CTES: dict[str, str] = {}

CTES["punches"] = f"""
select {loc('user_id')} as location, {emp('user_id')} as id, event_id as seq,
  'W' || lpad(cast((user_id * 7919) % 100003 as varchar), 6, '0') as employee,
  tin as in_punch,
  tin + to_minutes(cast(case when gap is null or len <= gap then len
    when gap - 10 * (event_id % 4) >= 1 then gap - 10 * (event_id % 4) else gap end as integer)) as out_punch
from (select *, 30 + (event_id * 37) % 571 as len, date_diff('minute', tin, nxt) as gap
  from (select user_id, event_id, date_trunc('minute', ts) as tin,
      lead(date_trunc('minute', ts)) over (partition by user_id order by ts, event_id) as nxt
    from events where user_id is not null))
where gap is null or gap > 0"""

CTES["numbered"] = """
select *, date_diff('minute', in_punch, out_punch) as len_min, cast(in_punch as date) as work_date,
  row_number() over (partition by id order by in_punch, out_punch, seq) as rn
from punches"""

CTES["helped"] = """
select p.*, b.in_punch as prev_in, b.out_punch as prev_out, a.in_punch as next_in,
  a.out_punch as next_out, b.work_date as prev_date, a.work_date as next_date,
  b.len_min as prev_len, a.len_min as next_len,
  date_diff('minute', b.out_punch, p.in_punch)::double as break_min,
  date_diff('minute', p.out_punch, a.in_punch)::double as next_break_min,
  case p.location when 'BBB' then 90 else 60 end as threshold
from numbered p
left join numbered b on b.id = p.id and b.rn = p.rn - 1
left join numbered a on a.id = p.id and a.rn = p.rn + 1"""

CTES["shifted"] = """
select *, sum(new_shift::int) over (partition by id order by rn) as shift_no
from (select *, coalesce(break_min >= threshold, true) as new_shift from helped)"""

CTES["flagged"] = """
select *, coalesce(break_min > 0, false) and not new_shift as is_break,
  new_shift or break_min > 0 as is_new_punch
from shifted"""

CTES["shift_sums"] = """
select id, shift_no, sum(len_min) as shift_min, min(in_punch) as shift_start, min(rn) as first_rn,
  sum(is_break::int) as break_count
from flagged group by id, shift_no"""

CTES["stretches"] = """
select id, shift_no, rn,
  (select count(*) from flagged q where q.id = f.id and q.shift_no = f.shift_no and q.rn <= f.rn
     and q.is_new_punch) as punch_no
from flagged f"""

CTES["stretch_sums"] = """
select s.id, s.shift_no, s.punch_no, sum(f.len_min) as stretch_min
from stretches s join flagged f using (id, rn) group by all"""

CTES["break_ranks"] = """
select id, shift_no, rn, out_punch,
  rank() over (partition by id, shift_no order by out_punch, in_punch, seq) as break_order
from flagged where is_break"""

CTES["second_breaks"] = """
select b.id, b.shift_no, b.out_punch as second_break_start, sum(f.len_min) as to_second_min
from break_ranks b join shift_sums s using (id, shift_no)
join flagged f on f.id = b.id and f.shift_no = b.shift_no and f.rn <= b.rn
where b.break_order = 1 and s.break_count >= 2 group by b.id, b.shift_no, b.out_punch"""

CTES["waiver_rows"] = f"""
select {emp('c_custkey')} as id, c_custkey * 2 as seq,
  case c_custkey % 3 when 0 then 'x' when 1 then ' X ' else '' end as checked
from customer where c_custkey % 4 = 0
union all select {emp('c_custkey')}, c_custkey * 2 + 1, 'x' from customer where c_custkey % 8 = 0"""

CTES["waivers"] = """
select id, lower(trim(checked)) = 'x' as has_waiver
from waiver_rows w where seq = (select min(seq) from waiver_rows v where v.id = w.id)"""

CTES["register_base"] = """
select c_custkey as k, c_name, c_mktsegment, (15 + c_custkey % 40)::double as rate,
  coalesce(n, 0)::double as hn, coalesce(r, 0)::double as hr, coalesce(a, 0)::double as ha
from customer left join (
  select o_custkey, sum(l_quantity) filter (l_returnflag = 'N') as n,
    sum(l_quantity) filter (l_returnflag = 'R') as r, sum(l_quantity) filter (l_returnflag = 'A') as a
  from orders join lineitem on l_orderkey = o_orderkey group by o_custkey) on o_custkey = c_custkey"""

CTES["reg"] = f"""
select k, {emp('k')} as id, {loc('k')} as location, c_name as name, c_mktsegment as job,
  case when k % 11 = 0 then 'E' else 'N' end as flsa,
  case k % 13 when 0 then 'Terminated' when 1 then 'Leave' else 'Active' end as pos,
  date '2015-01-01' + (k % 3000)::int as hired,
  case when k % 13 = 0 then date '2024-01-10' end as ended,
  case when k % 11 = 0 and k % 2 = 1 then rate * 80 else rate end as rate_paid,
  hn, hr, ha, rate * hn as reg_earn, rate * 1.5::double * hr + {every(7, '1.25')} as ot_earn,
  {every(6, '12.5')} as misc, {every(9, '100 + k % 50')} as bonus, {every(10, '55')} as comm,
  {every(12, '20.25')} as grat, {every(15, '7.5')} as restr, {every(20, '3.75')} as bell,
  rate * 2 * ha + {every(5, '1.25')} as dt_earn,
  (k % 4)::double as brk_hours, rate * (k % 4) + {every(3, '0.5')} as brk_earn,
  (k % 3)::double as rest_hours, rate * (k % 3) as rest_earn,
  {every(8, '8')} as sick_hours, {every(8, '8')} * rate as sick_earn,
  {every(16, '16')} as vac_hours, {every(16, '16')} * rate as vac_earn
from register_base"""

CTES["rates"] = f"""
select *, {clean('base_rate + per_hour')} as rrop, per_hour * 0.5::double as half
from (select *, {rnd(div('reg_earn', 'hn'), 4)} as base_rate,
    case when bell + restr + grat + comm + bonus > 0 then 'YES' else '' end as non_disc,
    misc + bell + restr + grat + comm + bonus as total_nd,
    {div('misc + bell + restr + grat + comm + bonus', 'hn + hr + ha')} as per_hour
  from reg)"""


def due(amount: str, paid: str) -> str:
    """due, paid, variance"""
    amount = rnd(clean(amount), 2)
    return f"{amount} as due, {paid} as paid, {rnd(clean(f'{paid} - {amount}'), 2)} as variance"


CTES["due_ot"] = f"select *, {due('(base_rate * 1.5::double + half) * hr', 'ot_earn')} from rates"
CTES["due_dt"] = f"select *, {due('ha * ((base_rate + half) * 2)', 'dt_earn')} from rates"
for _name, _hours, _paid in (("break", "brk_hours", "brk_earn"), ("rest", "rest_hours", "rest_earn")):
    CTES[f"due_{_name}"] = (
        f"select *, {rnd(div('due', _hours), 2)} as ratio from "
        f"(select *, {due(f'rrop * {_hours}', _paid)} from rates)"
    )
CTES["due_sick"] = (
    f"select *, {rnd(div('due', 'sick_hours'), 2)} as ratio from (select *, "
    f"{due('sick_hours * sick_rate', 'sick_earn')} from (select *, "
    "case when flsa = 'E' then rate_paid / 80 else rrop end as sick_rate from rates))"
)
CTES["wages"] = f"""
select *, case when pos = 'Leave' then '' when flsa = 'N' and {rnd('base_rate', 2)} >= min_wage then ''
    when flsa = 'E' and rate_paid + sick_earn + vac_earn >= min_40 then '' else 'CHECK' end as min_check
from (select *, case location when 'CCC' then 18::double else 17.25::double end as min_wage,
  16.5::double * 40 * 52 * 2 / 26 as min_40 from rates)"""

CTES["facts"] = f"""
select f.*, s.shift_start, s.break_count, {rnd('s.shift_min / 60', 4)} as shift_hours,
  st.punch_no, {rnd('ss.stretch_min / 60', 4)} as punch_hours,
  br.break_order, sb.second_break_start, sb.to_second_min / 60 as hours_to_second,
  {rnd('s.shift_min / 60', 4)} >= 12 and (s.break_count < 2 or coalesce(sb.to_second_min > 600, false)) as twelve,
  r.brk_hours as paid_break, r.hired, r.rate_paid, coalesce(w.has_waiver, false) as has_waiver,
  r.rate_paid * ((f.len_min + f.prev_len) / 60) as split_paid,
  17.25::double * (1 + (f.len_min + f.prev_len) / 60) as split_min,
  not exists (select 1 from flagged e where e.id = f.id and e.work_date = f.work_date and e.rn < f.rn) as first_of_day
from flagged f join shift_sums s using (id, shift_no)
join stretches st on st.id = f.id and st.rn = f.rn
join stretch_sums ss on ss.id = f.id and ss.shift_no = f.shift_no and ss.punch_no = st.punch_no
left join break_ranks br on br.id = f.id and br.rn = f.rn
left join second_breaks sb on sb.id = f.id and sb.shift_no = f.shift_no
left join reg r on r.id = f.id
left join waivers w on w.id = f.id"""

CTES["marks"] = """
select *, coalesce(break_min < 30, false) and shift_hours >= 5 and is_break as short_break,
  shift_hours > 6 and new_shift and punch_hours > 5 as first_meal,
  new_shift and is_new_punch and punch_hours > 5 and not (shift_hours <= 6 and has_waiver) as no_break_any,
  new_shift and punch_hours > 5 and not has_waiver and shift_hours > 5 and shift_hours <= 6 as no_break,
  shift_hours > 0 and shift_hours < 4 as short_shift,
  coalesce(break_min > 60 and break_min < 800 and split_paid < split_min and work_date = prev_date, false) as split,
  coalesce(work_date = prev_date, false) as same_date,
  first_of_day and twelve as over_twelve
from facts"""

CTES["summary"] = """
select * , due - paid as variance from (
  select id, arg_min(employee, (in_punch, out_punch, seq)) as employee, max(paid_break) as paid,
    sum(short_break::int)::bigint as sb, sum(no_break::int)::bigint as nb,
    sum(first_meal::int)::bigint as fm, sum(over_twelve::int)::bigint as ot,
    sum(short_break::int + no_break::int + first_meal::int + over_twelve::int)::bigint as due
  from marks group by id)
where sb <> 0 or nb <> 0 or fm <> 0 or ot <> 0 or paid is distinct from 0"""

CTES["pieces"] = """
select employee, id, location, cast(in_punch as date) as workday,
  case when cast(in_punch as date) = cast(out_punch as date) then date_diff('minute', in_punch, out_punch)
    else date_diff('minute', in_punch, date_trunc('day', out_punch)) end as m
from punches
union all
select employee, id, location, cast(out_punch as date), date_diff('minute', date_trunc('day', out_punch), out_punch)
from punches where cast(in_punch as date) <> cast(out_punch as date)"""

CTES["days"] = """
select employee, id, location, workday, m, ot_max,
  least(m, ot_max) as reg0, greatest(0, least(m - ot_max, 720 - ot_max)) as ot0, greatest(0, m - 720) as dt0,
  cast(workday - ((isodow(workday) % 7))::int as date) as workweek,
  date '2024-01-26' + 14 * cast(floor((workday - date '2024-01-07') / 14) as int) as fiscal,
  row_number() over (partition by id order by workday, employee, location) as n
from (select employee, id, location, workday, sum(m) as m,
    case location when 'BBB' then 450 else 480 end as ot_max
  from pieces group by employee, id, location, workday)"""

# One step per row: the plain walk the streak rule describes.
CTES["walk"] = """
select id, n, workday, location = 'CCC' as rolling, 1::bigint as streak, workday as started from days where n = 1
union all
select d.id, d.n, d.workday, w.rolling,
  case when d.workday - w.workday > 1 then 1
    when not w.rolling and isodow(w.workday) <> 7 and isodow(d.workday) = 7 then 1 else w.streak + 1 end,
  case when d.workday - w.workday > 1 then d.workday
    when not w.rolling and isodow(w.workday) <> 7 and isodow(d.workday) = 7 then d.workday else w.started end
from walk w join days d on d.id = w.id and d.n = w.n + 1"""

CTES["premium"] = """
select d.*, w.streak, w.started, w.streak > 6 as flagged,
  case when w.streak > 6 then 0 else reg0 end as reg1,
  case when w.streak > 6 then least(m, 480) else ot0 end as ot1,
  case when w.streak > 6 then greatest(m - 480, 0) else dt0 end as dt1
from days d join walk w using (id, n)"""

CTES["week_rows"] = """
select *, row_number() over (partition by id, workweek order by n) as wn from premium"""

CTES["spill"] = """
select id, workweek, wn, n, reg1 as cum, greatest(0, reg1 - 2400) as over, least(reg1, 2400) as held
from week_rows where wn = 1
union all
select r.id, r.workweek, r.wn, r.n, s.held + r.reg1, greatest(0, s.held + r.reg1 - 2400),
  least(s.held + r.reg1, 2400)
from spill s join week_rows r on r.id = s.id and r.workweek = s.workweek and r.wn = s.wn + 1"""

CTES["daily"] = f"""
select p.*, {rnd('m / 60', 4)} as hours_worked, {rnd('(reg1 - over) / 60', 4)} as regular_hours,
  {rnd('(ot1 + over) / 60', 4)} as ot_hours, {rnd('dt1 / 60', 4)} as dt_hours,
  {rnd('cum / 60', 4)} as cum_regular, {rnd('over / 60', 4)} as spillover
from premium p join spill s using (id, n)"""

CTES["totals"] = f"""
select id, employee, fiscal, {rnd('sum(ot_hours)', 4)} as ot_period, {rnd('sum(dt_hours)', 4)} as dt_period
from daily group by all"""

CTES["audited"] = f"""
select d.*, t.ot_period, t.dt_period, r.hr as ot_paid, r.ha as dt_paid,
  {rnd('t.ot_period - r.hr', 4)} as ot_var, {rnd('t.dt_period - r.ha', 4)} as dt_var,
  case when flagged then (select min(e.workday) from daily e where e.id = d.id and e.employee = d.employee
    and e.workweek = d.workweek and e.fiscal = d.fiscal) end as first_day,
  case when flagged then {rnd('least(hours_worked, 8)', 4)} else 0::double end as consec_ot,
  case when flagged then {rnd('greatest(hours_worked - 8, 0)', 4)} else 0::double end as consec_dt,
  d.n = (select min(e.n) from daily e where e.id = d.id and e.fiscal = d.fiscal) as first_of_id
from daily d join totals t using (id, employee, fiscal) left join reg r on r.id = d.id
where fiscal = date '2024-01-26'"""

_RECURSIVE = {"walk", "spill", "inside_walk", "inside_spill"}


def statement(final: str, joined: bool = False) -> str:
    """``final`` preceded by the CTEs it needs. With ``joined`` it begins with CTEs of its own."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [f"{n} as ({CTES[n].strip()})" for n in CTES if n in needed]
    if not parts:
        return final
    head = "with recursive " if needed & _RECURSIVE else "with "
    return head + ",\n".join(parts) + (",\n" if joined else "\n") + final.strip()
