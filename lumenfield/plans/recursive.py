"""DuckDB SQL of iterative results, as recursive table expressions, for the comparison of queries with SQL."""

from __future__ import annotations

_EDGE = "0.99999::double"


def clip(x: str, y: str) -> tuple[str, str]:
    """A point pulled back to the largest norm."""
    n = f"sqrt({x}*{x}+{y}*{y})"
    return tuple(f"(case when {n} >= {_EDGE} then {c}*({_EDGE}/{n}) else {c} end)" for c in (x, y))


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _tangents(name: str, source: str) -> str:
    """The weighted sum of the tangents from (x, y) to the points: ``source`` with gx and gy."""
    uu, dot, vv = "(x*x+y*y)", "(x*p.x+y*p.y)", "(p.x*p.x+p.y*p.y)"
    below = f"greatest(1-2*{dot}+{uu}*{vv}, 1e-9::double)"
    moved = f"list_transform(pts, lambda p: {{'w': p.w, 'x': ((1-2*{dot}+{vv})*(-x)+(1-{uu})*p.x)/{below}, 'y': ((1-2*{dot}+{vv})*(-y)+(1-{uu})*p.y)/{below}}})"
    n = "sqrt(q.x*q.x+q.y*q.y)"
    part = lambda c: f"list_sum(list_transform(m, lambda q: case when {n} < 1e-9::double then 0 else q.w*(1-{uu})*atanh(least({n}, {_EDGE}))*q.{c}/{n} end))"
    return f"{name} as (select * exclude (m), {part('x')} as gx, {part('y')} as gy from (select *, {moved} as m from {source}))"


def _moved(length: str) -> tuple[str, str]:
    """(x, y) moved along (gx, gy) by ``length`` times that vector."""
    g = "sqrt(gx*gx+gy*gy)"
    bx, by = (f"(tanh({length}*{g}/(1-x*x-y*y))*{c}/{g})" for c in ("gx", "gy"))
    dot, vv = f"(x*{bx}+y*{by})", f"({bx}*{bx}+{by}*{by})"
    below = f"greatest(1+2*{dot}+(x*x+y*y)*{vv}, 1e-9::double)"
    return f"(((1+2*{dot}+{vv})*x+(1-x*x-y*y)*{bx})/{below})", f"(((1+2*{dot}+{vv})*y+(1-x*x-y*y)*{by})/{below})"


def karcher(source: str, name: str = "placed") -> str:
    """Weighted barycentres of ``source`` (key, x, y, w): expressions that end in ``name`` (key, x, y)."""
    cx, cy = clip("x", "y")
    sx, sy = clip("mx", "my")
    tx, ty = _moved("1")
    nx, ny = clip("tx", "ty")
    return f"""{name}_k as (select key, list({{'x': {cx}, 'y': {cy}, 'w': greatest(w, 0)}}) as ps, sum(greatest(w, 0)) as t, count(*) as n, sum(greatest(w, 0)*x) as wx, sum(greatest(w, 0)*y) as wy, sum(x) as ux, sum(y) as uy from {source} group by key),
 {name}_m as (select key, list_transform(ps, lambda p: {{'x': p.x, 'y': p.y, 'w': case when t < 1e-9::double then 1.0::double/n else p.w/t end}}) as pts, case when t < 1e-9::double then ux/n else wx/t end as mx, case when t < 1e-9::double then uy/n else wy/t end as my from {name}_k),
 {name}_r as (select key, pts, {sx} as x, {sy} as y, 0 as it from {name}_m union all
  (with {_tangents('g', f'{name}_r')} select key, pts, {nx} as x, {ny} as y, it + 1 as it from (select *, {tx} as tx, {ty} as ty from g where it < 64 and sqrt(gx*gx+gy*gy) >= 1e-7::double))),
 {name} as (select key, arg_max(x, it) as x, arg_max(y, it) as y from {name}_r group by key)"""


def _cost(x: str, y: str) -> str:
    """The mean squared distance of a point from the points."""
    return f"list_sum(list_transform(pts, lambda p: pow(acosh(greatest(1.0::double, 1+2*(({x}-p.x)*({x}-p.x)+({y}-p.y)*({y}-p.y))/greatest((1-{x}*{x}-{y}*{y})*(1-p.x*p.x-p.y*p.y), 1e-9::double))), 2)*p.w))"


def frechet(source: str, name: str = "means") -> str:
    """Intrinsic means of ``source`` (key, x, y) by descent with step halving: expressions that end in ``name`` (key, n, x, y, pts).

    One step of the recursion is one trial: it is taken if the cost falls, else the next trial goes half as far.
    """
    cx, cy = clip("x", "y")
    sx, sy = clip("mx", "my")
    tx, ty = _moved("step")
    nx, ny = clip("tx", "ty")
    halves = _moved("0.5::double")
    return f"""{name}_k as (select key, list({{'x': {cx}, 'y': {cy}, 'w': 1.0::double}} order by x, y) as ps, count(*) as n from {source} group by key),
 {name}_m as (select key, n, list_transform(ps, lambda p: {{'x': p.x, 'y': p.y, 'w': 1.0::double/n}}) as pts, list_sum(list_transform(ps, lambda p: p.x))/n as mx, list_sum(list_transform(ps, lambda p: p.y))/n as my from {name}_k),
 {name}_r as (select key, n, pts, {sx} as x, {sy} as y, 1.0::double as step, 0 as round, 0 as it, true as live from {name}_m where n > 2 union all
  (with {_tangents('g', f'{name}_r')}, t as (select *, {nx} as qx, {ny} as qy from (select *, {tx} as tx, {ty} as ty from g where live and round < 256 and sqrt(gx*gx+gy*gy) >= 1e-9::double)), j as (select *, {_cost('qx', 'qy')} < {_cost('x', 'y')} - 1e-12::double as better from t)
   select key, n, pts, case when better then qx else x end as x, case when better then qy else y end as y, case when better then 1.0::double else step/2 end as step, round + better::int as round, it + 1 as it, better or step/2 > 1e-8::double as live from j)),
 {name}_two as (with {_tangents('g', f'(select key, n, list_transform(pts[2:2], lambda p: {{{chr(39)}x{chr(39)}: p.x, {chr(39)}y{chr(39)}: p.y, {chr(39)}w{chr(39)}: 1.0::double}}) as pts, pts as whole, pts[1].x as x, pts[1].y as y from {name}_m where n = 2)')} select key, n, case when sqrt(gx*gx+gy*gy) < 1e-9::double then x else {halves[0]} end as x, case when sqrt(gx*gx+gy*gy) < 1e-9::double then y else {halves[1]} end as y, whole as pts from g),
 {name} as (select key, any_value(n) as n, arg_max(x, it) as x, arg_max(y, it) as y, any_value(pts) as pts from {name}_r group by key union all select key, n, pts[1].x, pts[1].y, pts from {name}_m where n = 1 union all select key, n, x, y, pts from {name}_two)"""
