"""SQL twins of the queries that SQL can express."""

op10_top_k = """
with v as (
    select vec_id, len(embedding) d, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, q.d + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
    from v q join v c on q.d = c.d and q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

op2_minhash_near_dedup = """
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words
    from documents),
s as (
    select doc_id, case when len(words) = 0 then []
        when len(words) < 4 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 2),
            lambda i: array_to_string(words[i:i + 3], ' '))) end shingles
    from w),
e as (select doc_id, len(shingles) n, unnest(shingles) shingle from s),
link as (
    select x.doc_id a, y.doc_id b from e x join e y on x.shingle = y.shingle and x.doc_id <> y.doc_id
    group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) as (
    select doc_id, doc_id from s
    union
    select reach.a, link.b from reach join link on reach.b = link.a)
select s.doc_id, cast(len(s.shingles) as bigint) n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select a, min(b) component_id from reach group by a) c on s.doc_id = c.a
"""
