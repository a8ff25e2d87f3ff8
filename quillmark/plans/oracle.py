"""SQL views, for the oracle, of what quillmark.sources.views derives from the tables."""

EVENTS = """
em as (
  select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as book_id,
    case when user_id % 11 <> 0 then 'u' || user_id end as author, event_id % 37 as thread_id, event_id as comment_id,
    cast(epoch(cast(cast(ts as date) as timestamp)) as bigint) as created_at,
    case event_type when 'purchase' then 'recommended' when 'signup' then 'positive' when 'error' then 'negative' else 'neutral' end as label,
    case event_type when 'purchase' then 0.95 when 'signup' then 0.65 when 'error' then 0.0 else 0.2 end::double as recommendation_strength,
    case event_type when 'purchase' then 0.9 when 'signup' then 0.6 when 'error' then -0.8 else 0.0 end::double as sentiment,
    case when event_id % 7 = 0 then 'unresolved' else 'resolved' end as status
  from events
)"""

ORDERS = """
om as (
  select l_orderkey * 1000000 + l_partkey as id, l_partkey as book_id, case when o_custkey % 11 <> 0 then 'c' || o_custkey end as author,
    cast(c_nationkey as bigint) as thread_id, l_orderkey as comment_id, cast(epoch(cast(cast(o_orderdate as date) as timestamp)) as bigint) as created_at,
    case when m.flag = 'R' then 0.0 when m.flag = 'N' then 0.95 when m.off < 0.03 then 0.2 else 0.65 end::double as recommendation_strength,
    case when m.flag = 'R' then -0.8 when m.flag = 'N' then 0.9 when m.off < 0.03 then 0.0 else 0.6 end::double as sentiment,
    case when m.q > 45 then [c_mktsegment, o_orderpriority] else [] end as topics
  from (
    select l_orderkey, l_partkey, max({'q': l_quantity, 'p': l_extendedprice, 'off': l_discount, 'flag': l_returnflag}) as m
    from lineitem group by l_orderkey, l_partkey
  ) join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
)"""

TOPICS = """
ot as (
  select id as mention_id, book_id, unnest(topics) as name, unnest(case when len(topics) > 0 then [0.8, 0.5] else [] end)::double as confidence from om
)"""


def opinions(mentions: str) -> str:
    return f"""
op as (
  select *, author is null or author = '' as anonymous, case when author is null or author = '' then '' else author end as reader,
    recommendation_strength >= 0.6 and sentiment > 0 as good
  from {mentions} where (recommendation_strength >= 0.6 and sentiment > 0) or sentiment < 0
),
ol as (select * from op qualify created_at = max(created_at) over (partition by book_id, anonymous, reader)),
win as (
  select *, min(good::int) over (partition by book_id, anonymous, reader) <> max(good::int) over (partition by book_id, anonymous, reader) as conflict
  from ol
  qualify row_number() over (partition by book_id, anonymous, reader order by recommendation_strength desc, sentiment desc, thread_id, comment_id) = 1
)"""


def scores(mentions: str, as_of: int) -> str:
    return f"""{opinions(mentions)},
w as (
  select *, case when anonymous then 0.25 else 1.0 end::double as wt, pow(0.5::double, greatest(0, {as_of} - created_at) / 86400.0::double / 365) as decay
  from win
),
won as (
  select book_id,
    coalesce(sum(wt * recommendation_strength) filter (not conflict and good), 0) as positive_weight,
    coalesce(sum(wt * 0.5::double) filter (not conflict and not good), 0) as negative_weight,
    coalesce(sum(wt * recommendation_strength * decay) filter (not conflict and good), 0) as recent_positive,
    coalesce(sum(wt * 0.5::double * decay) filter (not conflict and not good), 0) as recent_negative,
    coalesce(sum(wt) filter (not conflict and good), 0) as voters,
    count(*) filter (not conflict and good) as independent_contexts,
    count(*) filter (not conflict and anonymous) as anonymous_opinions,
    count(*) filter (not conflict and good and not anonymous) as positive_users,
    count(*) filter (not conflict and not good and not anonymous) as negative_users,
    count(*) filter (conflict) as conflicting_readers,
    count(distinct thread_id) filter (not conflict and good) as positive_threads,
    count(distinct created_at // 86400) filter (not conflict and good) as positive_dates
  from w group by book_id
),
every_ as (
  select book_id, count(*) as mention_count, count(*) filter (recommendation_strength >= 0.6 and sentiment > 0) as recommendation_count,
    count(distinct thread_id) as thread_count
  from {mentions} where book_id is not null group by book_id
),
j as (
  select e.*, coalesce(positive_weight, 0)::double as positive_weight, coalesce(negative_weight, 0)::double as negative_weight,
    coalesce(recent_positive, 0)::double as rp, coalesce(recent_negative, 0)::double as rn, coalesce(voters, 0)::double as voters,
    coalesce(independent_contexts, 0) as independent_contexts, coalesce(anonymous_opinions, 0) as anonymous_opinions,
    coalesce(positive_users, 0) as positive_users, coalesce(negative_users, 0) as negative_users, coalesce(conflicting_readers, 0) as conflicting_readers,
    coalesce(positive_threads, 0) as positive_threads, coalesce(positive_dates, 0) as positive_dates
  from every_ e left join won using (book_id)
),
k as (
  select *, greatest(0, positive_weight - negative_weight) as net_support, voters / (voters + 2) as support_multiplier,
    1 + least(0.1::double * ln(1 + greatest(0, positive_threads - 1)::double), 0.15::double) + least(0.05::double * ln(1 + greatest(0, positive_dates - 1)::double), 0.1::double) as diversity_multiplier
  from j
),
score as (
  select book_id, mention_count, recommendation_count, positive_users as independent_recommenders, thread_count,
    round(cast(net_support * (support_multiplier * diversity_multiplier) as decimal(18, 9)), 4)::double as all_time_score,
    round(cast(greatest(0, rp - rn) * (support_multiplier * diversity_multiplier) as decimal(18, 9)), 4)::double as recent_score,
    independent_contexts, positive_users, negative_users, positive_threads, positive_dates, conflicting_readers, anonymous_opinions,
    round(cast(positive_weight as decimal(18, 9)), 6)::double as positive_weight, round(cast(negative_weight as decimal(18, 9)), 6)::double as negative_weight, round(cast(net_support as decimal(18, 9)), 6)::double as net_support,
    round(cast(support_multiplier as decimal(18, 9)), 6)::double as support_multiplier, round(cast(diversity_multiplier as decimal(18, 9)), 6)::double as diversity_multiplier, 2 as formula_version
  from k
)"""
