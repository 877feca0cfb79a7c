"""DuckDB SQL oracles for the registered queries (same names, same columns).

The tables are the driver's views.  Float results use the same rounding
as the Spark side; ``+ 0.0`` folds ``-0.0`` into ``0.0``.
"""

from __future__ import annotations

RATINGS = """ratings as (
  select o_custkey as user_id, cast(substr(p_brand, 7) as bigint) as item_id, sum(l_quantity) as rating
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  group by 1, 2)"""

# closed-form Cholesky of the 3 x 3 Gram matrix: R of the stacked rows
R3 = """with g as (
  select sum(l_quantity*l_quantity) a11, sum(l_quantity*l_discount) a12, sum(l_quantity*l_tax) a13,
         sum(l_discount*l_discount) a22, sum(l_discount*l_tax) a23, sum(l_tax*l_tax) a33 from lineitem),
 r1 as (select *, sqrt(a11) r11, a12/sqrt(a11) r12, a13/sqrt(a11) r13 from g),
 r2 as (select *, sqrt(a22 - r12*r12) r22 from r1),
 r3 as (select *, (a23 - r12*r13)/r22 r23 from r2),
 r4 as (select *, sqrt(a33 - r13*r13 - r23*r23) r33 from r3)
select i::bigint as i, j::bigint as j, round(r, 6) + 0.0 as r from (
  select 0 i, 0 j, r11 r from r4 union all select 0, 1, r12 from r4 union all select 0, 2, r13 from r4
  union all select 1, 1, r22 from r4 union all select 1, 2, r23 from r4 union all select 2, 2, r33 from r4)"""

# Cholesky of the Gram matrix of all components, one elimination per step, then forward substitution per row
QR_ALL = """with recursive e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
 g as (select a.i, b.i as j, sum(a.x*b.x) as g from e a join e b using (vec_id) group by 1, 2),
 rows as (select i, list(g order by j) as r from g group by i),
 steps as (
  select 1 as k, list(r order by i) as m from rows
  union all
  select k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j: x - m[k][i]*m[k][j]/m[k][k]))
  from steps where k < len(m)),
 r as (select k, list_transform(m[k], lambda x: x / sqrt(m[k][k])) as r from steps),
 q as (
  select vec_id, 0 as k, embedding::double[] as v, 0.0::double as q from embeddings
  union all
  select vec_id, q.k + 1, list_transform(v, lambda x, j: x - v[q.k + 1] / r.r[q.k + 1] * r.r[j]), v[q.k + 1] / r.r[q.k + 1]
  from q join r on r.k = q.k + 1)
select vec_id, (k - 1)::bigint as j, round(q, 7) + 0.0 as q from q where k > 0"""

# the counter-based generator: x^5 mod p times 48271 mod p, four times
def _step(x: str, keep: str, source: str) -> str:
    """SQL of one step: columns ``keep`` and ``x``, from column expression ``x`` of ``source``."""
    return f"""(select {keep}, (f * x % 2147483647) * 48271 % 2147483647 as x from (
      select *, (s * s) % 2147483647 as f from (select *, (x * x) % 2147483647 as s from (
        select {keep}, ({x}) % 2147483647 as x from {source}))))"""


_KEYS = "(select p_partkey::bigint as node, 0::bigint as x from part)"
_KEYED = _step("x + node // 2147483647 % 2147483647", "node", _step("x + node % 2147483647", "node", _step("7 + 1", "node", _KEYS)))
_CELLS = _step("x + c", "node, c", f"(select node, x, c from {_KEYED}, range(64) r(c))")
RANDOM_CELLS = f"""cells as (
 select node, c, c // 8 as i, c % 8 as j, case when c % 8 >= c // 8 then x / 2147483647::double else 0.0 end as u from {_CELLS})"""

RESIDUAL = """select (vec_id // 64)::bigint as block, 0.0::double as residual, count(*)::bigint as n_rows, 0::bigint as missing
from embeddings group by 1"""

SCORES = f"""with {RATINGS},
 s as (select a.item_id i, b.item_id j, sum(a.rating*b.rating) g from ratings a join ratings b using (user_id) group by 1, 2),
 sc as (select a.user_id, s.j as item_id, sum(a.rating*s.g) score from ratings a join s on a.item_id = s.i group by 1, 2)"""

TOPN = SCORES + """,
 f as (select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) rk
       from sc where score > 1)"""

ORACLES: dict[str, str] = {
    "text_contains_count": """
select count_if(contains(line, 'a'))::bigint as lines_with_a, count_if(contains(line, 'b'))::bigint as lines_with_b
from (select unnest(string_split(text, chr(10))) as line from documents)""",
    "parse_dense_rows": """
select vec_id as row_id, (generate_subscripts(embedding, 1) - 1)::bigint as j, unnest(embedding)::double as v
from embeddings""",
    "block_counts": "select (vec_id // 64)::bigint as block, count(*)::bigint as n_rows from embeddings group by 1",
    "parse_ratings": """
select o_custkey as user_id, cast(substr(p_brand, 7) as bigint) as item_id, l_quantity as rating
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "dedupe_ratings": f"with {RATINGS} select user_id, item_id, rating from ratings",
    "user_rows": f"""with {RATINGS}
select user_id, count(*)::bigint as n_items,
       string_agg(item_id::varchar || ':' || rating::varchar, ',' order by item_id) as items_text
from ratings group by user_id""",
    "qr_r": R3,
    "qr_r_schedule": R3,
    "combine_r": R3,
    "qr_q": QR_ALL,
    "qr_q_indirect": QR_ALL,
    "qr_q_refined": QR_ALL,
    "qr_q_saved": QR_ALL,
    "qr_residual": RESIDUAL,
    "qr_residual_sum": RESIDUAL,
    "qr_orthogonality": """
with d as (select distinct unnest(generate_series(0, len(embedding) - 1)) as i from embeddings)
select a.i::bigint as i, b.i::bigint as j, case when a.i = b.i then 1.0 else 0.0 end::double as g
from d a, d b""",    "qr_refined_orthogonality": """
with d as (select distinct unnest(generate_series(0, len(embedding) - 1)) as i from embeddings)
select a.i::bigint as i, b.i::bigint as j, case when a.i = b.i then 1.0 else 0.0 end::double as g
from d a, d b""",
    "random_r_blocks": f"with {RANDOM_CELLS} select node, list(u order by c) as r from cells group by node",
    "random_r_combined": f"""with recursive {RANDOM_CELLS},
 g as (select a.j as i, b.j as j, sum(a.u * b.u) as g from cells a join cells b using (node, i) group by 1, 2),
 rows as (select i, list(g order by j) as r from g group by i),
 steps as (
  select 1 as k, list(r order by i) as m from rows
  union all
  select k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j: x - m[k][i]*m[k][j]/m[k][k]))
  from steps where k < len(m))
select (k - 1)::bigint as i, (j - 1)::bigint as j, round(m[k][j] / sqrt(m[k][k]), 6) + 0.0 as r
from steps, range(1, 9) t(j) where j >= k""",
    "random_projection": f"""with {RATINGS},
 om as (select distinct item_id, c, ((item_id*7 + c*3) % 11 - 5) / 5.0 as w
        from ratings, (select unnest(generate_series(0, 4)) as c))
select user_id, c::bigint as c, round(sum(rating * w), 6) + 0.0 as y
from ratings join om using (item_id) group by 1, 2""",
    "at_times_q": f"""with {RATINGS},
 q as (select distinct user_id, c, ((user_id*3 + c*5) % 13 - 6) / 6.0 as q
       from ratings, (select unnest(generate_series(0, 3)) as c))
select item_id, c::bigint as c, round(sum(rating * q), 6) + 0.0 as b
from ratings join q using (user_id) group by 1, 2""",
    "gram": """
with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)
select a.i::bigint as i, b.i::bigint as j, round(sum(a.x*b.x), 9) + 0.0 as g
from e a join e b using (vec_id) group by 1, 2""",
    "ssvd_sigma_moments": SCORES.replace(",\n sc as", ",\n unused as") + """
select round((select sum(rating*rating) from ratings), 0) + 0.0 as sum_sigma2,
       round((select sum(g*g) from s) / 1e9, 0) + 0.0 as sum_sigma4_e9""",
    "ssvd_dense_sigma_moments": """
with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
 g as (select a.i, b.i as j, sum(a.x*b.x) as g from e a join e b using (vec_id) group by 1, 2)
select round((select sum(x*x) from e), 6) + 0.0 as sum_sigma2, round((select sum(g*g) from g), 6) + 0.0 as sum_sigma4""",
    "ssvd_rank10": f"""with {RATINGS}
select j::bigint as j, 0.0::double as residual, 1.0::double as length, true as in_order,
       (select round(sum(rating*rating), 0) + 0.0 from ratings) as sum_all_sigma2
from range(10) t(j)""",
    "ssvd_rank_deficient": f"""with {RATINGS}
select round(2 * sum(rating*rating), 0) + 0.0 as sum_sigma2, count(distinct item_id)::bigint as n_zero,
       count(distinct item_id)::double as u_length2, count(distinct item_id)::double as v_length2,
       count(distinct item_id)::bigint as v_unit, 0.0::double as v_off_diagonal
from ratings""",
    "factors_rewritten": f"""with {RATINGS}
select count(distinct item_id)::bigint as n_v, true as u_is_absent, round(9 * sum(rating*rating), 0) + 0.0 as sum_sigma2
from ratings""",
    "text_row_ids": """
select vec_id, (row_number() over (order by vec_id) - 1)::bigint as id_small_splits,
       (row_number() over (order by vec_id) - 1)::bigint as id_large_splits
from embeddings""",
    "ssvd_reconstruct": f"with {RATINGS} select user_id, item_id, rating + 0.0 as value from ratings",
    "ssvd_half_sigma": f"with {RATINGS} select user_id, item_id, rating + 0.0 as value from ratings",
    "cf_scores": SCORES + """
select r.user_id, r.item_id, round(sc.score, 0) + 0.0 as score
from ratings r join sc on r.user_id = sc.user_id and r.item_id = sc.item_id""",
    "recommend_topn": TOPN + """
select user_id, item_id, round(score, 0) + 0.0 as score, rk::bigint as rank from f where rk <= 3""",
    "recommend_topn_nan": TOPN + """
select user_id, item_id, round(score, 0) + 0.0 as score, rk::bigint as rank from f where rk <= 3 and user_id % 7 <> 0""",
    "recommend_saved": TOPN + """
select user_id, item_id, round(score, 0) + 0.0 as score, rk::bigint as rank from f where rk <= 3""",
    "recommend_topn_unseen": SCORES + """,
 f as (select sc.user_id, sc.item_id, sc.score,
              row_number() over (partition by sc.user_id order by sc.score desc, sc.item_id) rk
       from sc anti join ratings r on r.user_id = sc.user_id and r.item_id = sc.item_id
       where sc.score > 1)
select user_id, item_id, round(score, 0) + 0.0 as score, rk::bigint as rank from f where rk <= 3""",
    "recommend_topn_split": SCORES + """,
 f as (select user_id, item_id, score / 1e9 as score,
              row_number() over (partition by user_id order by score desc, item_id) rk
       from sc where score > 1e9),
 users as (select distinct user_id from ratings)
select u.user_id, f.item_id, round(f.score, 9) + 0.0 as score, f.rk::bigint as rank
from users u left join (select * from f where rk <= 3) f on u.user_id = f.user_id""",
    "recommend_text": TOPN + """
select user_id, user_id::varchar || chr(9) || '[' ||
       string_agg(item_id::varchar || ':' || (round(score, 0)::bigint)::varchar || ',', '' order by rk) || ']' as value
from f where rk <= 3 group by user_id""",
    "merge_topn": """
select user_id, event_id, value, rk::bigint as rank from (
  select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) rk
  from events) where rk <= 3""",
}
