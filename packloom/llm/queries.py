"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from packloom.llm import chat, jaccard, media, mixing, pieces, quality, repeats, sharding, tokens, warc
from packloom.llm.common import table


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), tokenizer()), tokenizer())
    return rows.select("doc_id", "n_bytes", "n_chunks", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


def op2_rendezvous_shards(spark, sf_dir):
    return sharding.rendezvous(table(spark, sf_dir, "documents"), [1.0] * 24)


def op3_curriculum_mix(spark, sf_dir):
    return mixing.in_order(mixing.plan_mixture(table(spark, sf_dir, "documents"))).withColumn("positions", F.array_join(F.transform("positions", lambda x: F.format_string("%.6f", x)), ","))


def op4_adaptive_quality(spark, sf_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(table(spark, sf_dir, "documents")).select(columns)


def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer())


def op6_zstd_warc(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False)


def op7_repeated_strings(spark, sf_dir):
    """The columns of the 400-byte rule, and beside them passages of over fifty words, which take about 330 bytes and may take less than 400."""
    return repeats.removals(table(spark, sf_dir, "documents"), 400, 200)


def op8_media_sniffing(spark, sf_dir):
    return media.features(media.stored(table(spark, sf_dir, "documents")))


def op9_jaccard_classes(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"), 3, 90)


def op10_preference_format(spark, sf_dir):
    """Conversations 2 k and 2 k + 1 are the chosen and the rejected side of pair k."""
    turns = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns.select(F.floor(turns["conv_id"] / 2).alias("pair_id"), F.pmod(turns["conv_id"], F.lit(2)).alias("side"), turns["turn"], turns["role"], turns["text"]))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_rendezvous_shards, op3_curriculum_mix, op4_adaptive_quality, op5_token_counts, op6_zstd_warc, op7_repeated_strings, op8_media_sniffing, op9_jaccard_classes, op10_preference_format)}

ORACLES = {
    "op3_curriculum_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, (rank % 3 + 1)::bigint as weight, [0.5, 0.0, -0.5][rank % 3 + 1]::double as lean from s),
f as (select *, sum(source_size) over ()::bigint as all_size, sum(weight) over ()::bigint as all_weight,
  coalesce(sum(source_size * 3) over (order by source_size::double / weight::double, rank rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
  coalesce(sum(weight) over (order by source_size::double / weight::double, rank rows between unbounded preceding and 1 preceding), 0)::bigint as used from w),
l as (select *, (all_size - spent)::double / (all_weight - used)::double as level from f),
t as (select a.*, coalesce(least((a.source_size * 3)::double, a.weight::double * (select b.level from l b
  where b.level * b.weight <= b.source_size * 3 order by b.source_size::double / b.weight::double, b.rank limit 1)), (a.source_size * 3)::double) as capped from l a),
t2 as (select *, least(capped, (source_size * 3)::double) as target from t),
p as (select d.*, t2.source_size, t2.target, t2.lean,
  sum(size) over (partition by d.source order by key, size, doc_id rows unbounded preceding)::double - size::double / 2 as middle
  from d join t2 on d.source is not distinct from t2.source),
c as (select *, case when source_size > 0 then least(3, greatest(0, floor((target - middle) / source_size) + 1)) when target >= middle then 1 else 0 end::integer as copies from p)
select doc_id, size, source_size, target, size * copies as taken, copies,
  coalesce(array_to_string(list_transform(range(copies), lambda e: printf('%.6f', 2 * (case when target > 0 then (e * source_size + middle) / target else 0 end)
    / ((1 - lean) + sqrt((1 - lean) * (1 - lean) + 4 * lean * (case when target > 0 then (e * source_size + middle) / target else 0 end))))), ','), '') as positions
from c
""",
    "op4_adaptive_quality": r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
wl as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
w as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from wl),
g as (select r, i, array_to_string(list_slice(w, i, i + 7), ' ') as gram from (select r, w, unnest(range(1, len(w) - 6)) as i from wl where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from g) where n > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from twice, range(8) t(k) group by r),
ln as (select r, line, row_number() over (partition by r, line) as nth from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
l as (select r, count(*) filter (where nth > 1) as n_dup_lines, count(*) as n_lines from ln group by r),
ws as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
m as (select d.r, doc_id, lang, source, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from d left join ws using (r) left join l using (r) left join rep using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
s as (select *, unnest(['symbols', 'dup_lines', 'word_length']) as metric, unnest([case when word_chars > 0 then n_symbols::double / word_chars else 0 end,
  case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end, case when n_words > 0 then word_chars::double / n_words else 0 end]) as rate from b),
u as (select *, case when rate > 0 then greatest(least(ceil(ln(rate) / ln(1.01::double / 0.99::double)), 1100), -1100) else -10000 end::integer as bucket from s),
least_width as (select * from (values ('symbols', 0.01::double), ('dup_lines', 0.1::double), ('word_length', 0.5::double)) v(metric, width)),
k as (select 1 as level, lang, source, metric, bucket from u where not base_failed union all select 2, lang, null, metric, bucket from u where not base_failed union all select 3, null, null, metric, bucket from u where not base_failed),
q0 as (select level, lang, source, metric, count(*) as n, quantile_disc(bucket, 0.25) as b1, quantile_disc(bucket, 0.75) as b3 from k group by all),
q as (select *, case when b1 > -10000 then 2 * pow(1.01::double / 0.99::double, b1) / (1.01::double / 0.99::double + 1) else 0 end as q1,
  case when b3 > -10000 then 2 * pow(1.01::double / 0.99::double, b3) / (1.01::double / 0.99::double + 1) else 0 end as q3 from q0),
f as (select q.*, q1 - 6 * greatest(q3 - q1, width) as low, q3 + 6 * greatest(q3 - q1, width) as high from q join least_width using (metric)),
v as (select s.r, bool_and(coalesce(s.rate between case when a.n >= 50 then a.low when e.n >= 50 then e.low else c.low end
  and case when a.n >= 50 then a.high when e.n >= 50 then e.high else c.high end, true) or a.n is null) as inside
  from s left join f a on a.level = 1 and a.lang is not distinct from s.lang and a.source is not distinct from s.source and a.metric = s.metric
  left join f e on e.level = 2 and e.lang is not distinct from s.lang and e.metric = s.metric left join f c on c.level = 3 and c.metric = s.metric group by s.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside as kept from b join v using (r)
""",
    "op9_jaccard_classes": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) >= 3 then array_to_string(list_slice(w, i, i + 2), ' ') else array_to_string(w, ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select g from s group by g having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) join f using (g) where a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as reached from d union select r.node, e.b from r join e on e.a = r.reached)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.reached) as component_id from d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id
""",
    "op10_preference_format": r"""
with t as (select floor(conv_id / 2)::bigint as pair_id, conv_id % 2 as side, turn, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls last, role, text) as i from conversations where conv_id is not null),
j as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i, a.i is null or b.i is null or a.role <> b.role or a.text <> b.text as unlike
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.i = b.i),
n as (select pair_id, coalesce(min(i) filter (where unlike) - 1, max(i))::bigint as common from j group by pair_id),
r as (select t.*, n.common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as body,
  sum(case when i > common then length(role) + length(text) + 13 else 0 end) over (partition by pair_id, side order by i) - length(text) - 8 as pos
  from t join n using (pair_id))
select pair_id, any_value(common) as n_prompt_turns, (count(*) filter (where side = 0))::bigint as n_chosen_turns, (count(*) filter (where side = 1))::bigint as n_rejected_turns,
  coalesce(string_agg(body, '' order by i) filter (where side = 0 and i <= common), '') as prompt,
  case when count(*) filter (where side = 0) > 0 then coalesce(string_agg(body, '' order by i) filter (where side = 0 and i > common), '') end as chosen,
  case when count(*) filter (where side = 1) > 0 then coalesce(string_agg(body, '' order by i) filter (where side = 1 and i > common), '') end as rejected,
  case when count(*) filter (where side = 0) > 0 then coalesce(string_agg(pos::bigint || ':' || (length(text) + 8), ',' order by i) filter (where side = 0 and i > common and role = 'assistant'), '') end as chosen_mask,
  case when count(*) filter (where side = 1) > 0 then coalesce(string_agg(pos::bigint || ':' || (length(text) + 8), ',' order by i) filter (where side = 1 and i > common and role = 'assistant'), '') end as rejected_mask
from r group by pair_id
""",
}
