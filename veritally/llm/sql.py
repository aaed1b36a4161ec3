"""DuckDB SQL for the operators that SQL can express, written out on its own."""

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STOP = """the of and to in is that for it on with as was at by this be are from or an have not
  der die und das von zu mit den ist im des ein eine auf nicht sich auch dem als für es
  le la les de et un une du dans que qui est pour par sur au en pas ne se ce il
  el los las y del una con para no su lo al como más"""

OP7 = rf"""with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
  g as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from d, unnest(range(1, greatest(len(w) - 1, 1))) as r(i) where i + 2 <= len(w)),
  twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as k from g) where k > 1),
  hit as (select doc_id, count(distinct i + o) as n from twice, (values (0), (1), (2)) as v(o) group by doc_id),
  f as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(l) as n_lines,
      len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullets,
      len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_ellipses,
      len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+')), regexp_split_to_array('{STOP}', '\s+'))) as n_stop
    from d left join hit using (doc_id))
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars >= 2 * n_words and word_chars <= 20 * n_words
      and 10 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines and 10 * n_bullets <= 9 * n_lines and 2 * n_ellipses <= n_lines and n_stop >= 2 as kept
  from f"""

REACH = """reach as (select a as node, a as low from links union select a, b from links
    union select r.node, l.b from reach as r join links as l on l.a = r.low)"""

OP8 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
  links as (select x.vec_id as a, y.vec_id as b from v as x join v as y on x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.95),
  {REACH}
  select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(low, vec_id)::bigint as component_id, coalesce(low, vec_id) = vec_id as kept from v
    left join (select a, count(*) as n from links group by a) as c on c.a = vec_id
    left join (select node, min(low) as low from reach group by node) as r on r.node = vec_id"""

OP10 = rf"""with recursive d as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
  s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from d, unnest(range(1, greatest(len(w) - 3, 2))) as r(i) where len(w) > 0),
  n as (select doc_id, count(*)::bigint as n from s group by doc_id),
  pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from s as x join s as y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
  links as (select a, b from pairs join n as p on p.doc_id = a join n as q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
  {REACH}
  select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(low, doc_id)::bigint as component_id, coalesce(low, doc_id) = doc_id as kept
  from documents left join n using (doc_id) left join (select node, min(low) as low from reach group by node) as r on r.node = doc_id"""

OP11 = rf"""with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as p from documents),
  w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from d),
  sizes as (select lang, sum(len(w))::bigint as n from w group by lang),
  g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f from w, unnest([1, 2, 3]) as q(k), unnest(range(1, len(w) - k + 2)) as r(i) group by 1, 2, 3),
  c as (select *, string_split(phrase, ' ') as s from g where k > 1 and f >= 10),
  cuts as (select c.lang, c.phrase, c.k, c.f as a, x.k as place, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as score
    from c join g as x on x.lang = c.lang and x.k < c.k and x.phrase = array_to_string(c.s[1 : x.k], ' ')
    join g as y on y.lang = c.lang and y.k = c.k - x.k and y.phrase = array_to_string(c.s[x.k + 1 :], ' ')),
  lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, place) = 1),
  inside as (select lang, array_to_string(s[1 : 2], ' ') as phrase, f from c where k = 3 union all select lang, array_to_string(s[2 : 3], ' '), f from c where k = 3),
  longer as (select lang, phrase, max(f) as most from inside group by lang, phrase),
  kept as (select lowest.* from lowest left join longer using (lang, phrase) where k = 3 or 100 * coalesce(most, 0) < 50 * a),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
  select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join sizes using (lang) where rank <= 2000"""

OP12 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as e
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as a, a.label = b.label as same, b.vec_id as b, list_dot_product(a.e, b.e)::bigint as score from v as a join v as b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
  n as (select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
  select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
