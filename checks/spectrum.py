"""Principal components of any number of series in SQL: Jacobi rotations in a recursive table."""

from __future__ import annotations

SWEEPS = 10


def residual_sql(rows: str, k: int | None = None, target: float = 0.8, plus: int = 1) -> str:
    """CTEs from ``rows`` (slice_id, ts, split, series_id, v) to ``residual`` (the same keys, r).

    The components are those of the train split: ``k`` of them, or as many as ``target`` and ``plus`` ask for.
    One step turns one pair of series (p, q) so that their covariance becomes zero.  Needs ``with recursive``.
    """
    count = str(k) if k is not None else f"count(*) filter (share < {target} - 1e-12) over (partition by slice_id) + {plus}"
    return f"""numbered as (select *, dense_rank() over (partition by slice_id order by series_id) - 1 as i from {rows}),
    means as (select slice_id, i, avg(v) as m from numbered where split = 'train' group by 1, 2),
    centred as (select slice_id, ts, split, series_id, i, v - m as v from numbered join means using (slice_id, i)),
    products as (
      select a.slice_id, a.i, b.i as j, avg(a.v * b.v) as c from centred a join centred b using (slice_id, ts, split)
      where split = 'train' group by 1, 2, 3),
    turned as (
      select 0 as step, slice_id, cast(sqrt(count(*)) as bigint) as n, list(c order by i, j) as a,
             list(case when i = j then 1.0::double else 0.0::double end order by i, j) as u
      from products group by slice_id
      union all
      select step + 1, slice_id, n,
             list_transform(range(n * n), lambda x: case x // n when p then c * b[x + 1] - s * b[q * n + x % n + 1]
               when q then s * b[p * n + x % n + 1] + c * b[x + 1] else b[x + 1] end),
             u
      from (
        select *, list_transform(range(n * n), lambda x: case x % n when p then c * a[x + 1] - s * a[x - p + q + 1]
                 when q then s * a[x - q + p + 1] + c * a[x + 1] else a[x + 1] end) as b,
               list_transform(range(n * n), lambda x: case x % n when p then c * old[x + 1] - s * old[x - p + q + 1]
                 when q then s * old[x - q + p + 1] + c * old[x + 1] else old[x + 1] end) as u
        from (
          select * exclude (t), 1 / sqrt(t * t + 1) as c, t / sqrt(t * t + 1) as s from (
            select *, case when p = q or cross_cov = 0 then 0.0::double
                      else (case when gap >= 0 then 1 else -1 end) / (abs(gap) + sqrt(gap * gap + 1)) end as t
            from (
              select *, case when p = q or cross_cov = 0 then 0.0::double else (a[q * n + q + 1] - a[p * n + p + 1]) / (2 * cross_cov) end as gap
              from (
                select *, a[p * n + q + 1] as cross_cov
                from (select step, slice_id, n, a, u as old, step % n as p, (step // n) % n as q from turned)))))
        where step < {SWEEPS} * n * n)),
    axes as (
      select slice_id, k, a[k * n + k + 1] as eigenvalue, list_transform(range(n), lambda i: u[i * n + k + 1]) as axis
      from (select *, unnest(range(n)) as k from turned where step = {SWEEPS} * n * n)),
    shares as (
      select *, row_number() over w as rank,
             sum(eigenvalue) over (w rows between unbounded preceding and current row) / sum(eigenvalue) over (partition by slice_id) as share
      from axes window w as (partition by slice_id order by eigenvalue desc)),
    kept as (select slice_id, rank, axis from (select *, {count} as kept_count from shares) where rank <= kept_count),
    scores as (
      select slice_id, ts, split, rank, axis, sum(v * axis[i + 1]) as score
      from centred join kept using (slice_id) group by all),
    rebuilt as (
      select c.slice_id, c.ts, c.split, c.i, sum(s.score * s.axis[c.i + 1]) as v
      from centred c join scores s using (slice_id, ts, split) group by all),
    residual as (
      select c.slice_id, c.ts, c.split, c.series_id, c.v - coalesce(b.v, 0) as r
      from centred c left join rebuilt b using (slice_id, ts, split, i))"""
