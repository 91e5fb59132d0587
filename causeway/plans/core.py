"""Registration, and the SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def u(*parts: str) -> str:
    """SQL of the hashed uniform draw."""
    joined = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::ubigint / 4294967296.0)"


CELLS = "cells as (select vec_id as window_id, label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as var from embeddings)"
STATS = """med as (select var, quantile_cont(x, 0.5) as med, avg(x) as mean, stddev_pop(x) + 1e-9 as std from cells group by var),
stats as (select c.var, any_value(m.med) as med, any_value(m.mean) as mean, any_value(m.std) as std, quantile_cont(abs(c.x - m.med), 0.5) * 1.4826 + 1e-9 as mad
  from cells c join med m on c.var = m.var group by c.var)"""
#: Windows with a step of 0.35 added to one hashed variable.
ROOTS = f"roots as (select vec_id as window_id, label, cast(floor({u('0', 'vec_id', chr(39) + 'root' + chr(39))} * len(embedding)) as int) as root from embeddings)"
Z = """inj as (select c.window_id, c.label, c.var, c.x + case when c.var = r.root then 0.35::double else 0.0 end as x, r.root from cells c join roots r on c.window_id = r.window_id),
z as (select i.window_id, i.label, i.var, i.root, abs(i.x - s.med) / s.mad as z from inj i join stats s on i.var = s.var)"""
BASE = f"with {CELLS}, {STATS}, {ROOTS}, {Z}"


def noise(strength: float) -> str:
    """CTEs of the injected windows under noise of `strength` deviations, eight instances."""
    return f"""inst as (select unnest(range(8))::int as instance),
zp as (select i.window_id, i.label, i.var, i.root, n.instance, abs(i.x + s.mad * {strength} * sqrt(-2.0 * ln(1.0 - {u('n.instance', 'i.window_id', 'i.var', "'a'")})) * cos(2 * pi() * {u('n.instance', 'i.window_id', 'i.var', "'b'")}) - s.med) / s.mad as z
  from inj i join stats s on i.var = s.var, inst n),
top0 as (select window_id, label, root, var from (select *, row_number() over (partition by window_id order by z desc, var) as r from z) where r <= 3),
topm as (select window_id, label, root, instance, var from (select *, row_number() over (partition by window_id, instance order by z desc, var) as r from zp) where r <= 3),
acrs as (select m.window_id, m.label, m.instance, count(t.var) / 3.0 as acr, max(case when m.var = m.root then 1 else 0 end) as hit3
  from topm m left join top0 t on t.window_id = m.window_id and t.var = m.var group by m.window_id, m.label, m.instance)"""


NOISE = noise(0.5)
SERIES = """ev as (select cast(user_id % 4 as int) as unit, cast(floor(epoch_us(ts) / 3600000000) - 473352 as bigint) as t, event_type, value from events),
kinds as (select event_type, cast(row_number() over (order by event_type) - 1 as int) as var from (select distinct event_type from ev)),
spans as (select unit, min(t) as a, max(t) as b from ev group by unit),
grid as (select s.unit, unnest(range(s.a, s.b + 1)) as t from spans s),
sums as (select unit, t, event_type, sum(value) as x from ev group by unit, t, event_type),
series as (select g.unit, g.t, k.var, coalesce(s.x, 0.0) as x from grid g cross join kinds k left join sums s on s.unit = g.unit and s.t = g.t and s.event_type = k.event_type)"""
