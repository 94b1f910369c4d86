"""The flagship query: which dictionary words fit each redacted box, ranked."""

from ..operators import measure
from ..sources import layout, lines


def ranked(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure.ranked_candidates(lines.edges(docs), measure.dictionary(lines.vocabulary(docs))).select("doc_id", "token_idx", "mode", "rank", "text", "error_pt")


EDGES_SQL = """,
lay_e as (select *, last_value(case when not is_box then x1 end ignore nulls) over b as l_, first_value(case when not is_box then x0 end ignore nulls) over a as r_,
    last_value(case when is_box then x1 + 0.5::double end ignore nulls) over b as prev_box_x1, first_value(case when is_box then x0 - 0.5::double end ignore nulls) over a as next_box_x0 from tok
    window b as (partition by doc_id, line order by token_idx rows between unbounded preceding and 1 preceding), a as (partition by doc_id, line order by token_idx rows between 1 following and unbounded following)),
edge0 as (select doc_id, page_index, line, token_idx, token as target, units, font_size, x0 - 0.5::double as box_x0, x1 + 0.5::double as box_x1, prev_box_x1, next_box_x0,
    case when l_ is not null and r_ is not null then 'two_sided' when l_ is not null then 'left_only' when r_ is not null then 'right_only' else 'unresolved' end as mode,
    l_ + font_size * 278::double / 1000::double as left_edge, r_ - font_size * 278::double / 1000::double as right_edge from lay_e where is_box),
edge as materialized (select *, case when right_edge > left_edge then right_edge - left_edge else box_x1 - box_x0 end as target_width from edge0)
"""
DICT_SQL = """,
dict0 as (select upper(token) as norm, min(token) as text from tok where regexp_matches(token, '^[A-Za-z]{4,20}$') group by 1),
dict as (select d.*, u.units from dict0 d join (select distinct token, units from tok) u on u.token = d.text)
"""

QUERIES = {"m00_ranked_candidates": ranked}
ORACLE_SQL = {
    "m00_ranked_candidates": layout.SQL
    + EDGES_SQL
    + DICT_SQL
    + """,
r as (select *, case mode when 'two_sided' then right_edge - left_edge when 'left_only' then box_x1 - left_edge else right_edge - box_x0 end * 1000 / font_size as t_, 500.01::double / font_size as b_ from edge where mode <> 'unresolved'),
c as (select r.*, d.text, d.norm, d.units * font_size / 1000::double as w from r join dict d on d.units between t_ - b_ and t_ + b_),
e as (select *, round(case mode when 'two_sided' then abs(left_edge + w - right_edge) when 'left_only' then abs(left_edge + w - box_x1) else abs(right_edge - w - box_x0) end, 4) as error_pt,
    case mode when 'right_only' then right_edge - w else left_edge end as pl, case mode when 'right_only' then right_edge else left_edge + w end as pr from c),
k as (select *, row_number() over (partition by doc_id, token_idx order by error_pt, length(text) desc, norm) as rank from e
    where error_pt <= 0.5 and not coalesce(prev_box_x1 - pl > 1.0, false) and not coalesce(pr - next_box_x0 > 1.0, false))
select doc_id, token_idx, mode, rank::int as rank, text, error_pt from k where rank <= 20
"""
}
