"""One query per operator of this folder on the driver's tables, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from aerolith.llm import ball_search, bpe, chat_format, decontamination, html_extraction, near_dups, pii, prefix_trie, quality, sharding, substring_dedup, token_counts, warc
from aerolith.llm.base import table


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).cast("bigint"), F.lit(k).cast("bigint"), F.lit(r), F.lit("</s>[INST] ok [/INST]")) for k, r in enumerate(("user", "assistant"))]))).toDF("conv_id", "turn", "role", "text")
    rows = chat_format.format_chats(chats.unionByName(planted))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "identical",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    rows = warc.payload_facts(warc.read_archives(spark, path))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS).select("doc_id", F.col("slot").cast("bigint").alias("slot"), "shard")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *names, quality.failed("base/1").alias("base_failed"), "kept", "fail_bits")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(table(spark, sf_dir, "documents"))
    number = {f"n_{k}": F.size(F.filter("base", _kind_is(n))).cast("bigint") for n, k in enumerate(pii.KINDS[:4])}
    return rows.select("doc_id", *[c.alias(n) for n, c in number.items()], F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def _kind_is(kind: int):
    return lambda s: s["kind"] == kind


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dups": op6_minhash_near_dups,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_ball_search": op13_ball_search,
    "pipeline": corpus_pipeline.run,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op2_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, regexp_replace(regexp_replace(regexp_replace(text, '\\([elb])', '\\e\1', 'g'), '<(/?s>)', '\\l\1', 'g'), '\[(/?(INST|ANSWER|SYS|ROLE))', '\\b\1', 'g') shown,
  case role when 'user' then 'INST' when 'assistant' then 'ANSWER' when 'system' then 'SYS' else 'ROLE ' || role end name from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(length(shown) + 2 * length(name) + 14)::bigint formatted_chars, true identical
from e group by conv_id
""",
    "op3_warc": r"""
with p as (select page_id, coalesce(html, '') h from pages),
f as (select sha256(h) d, min(page_id) f from p where strlen(h) >= 100 group by 1)
select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest, case when f is not null and page_id <> f then 'revisit' else 'response' end record_type,
  case when page_id <> f then f end refers_to, true complete
from p left join f on f.d = sha256(h) and strlen(h) >= 100
""",
    "op6_minhash_near_dups": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[p : p + 4], ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
links as (
  select a.doc_id a, b.doc_id b from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
e as (select a, b from links union all select b, a from links),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id where r.root < e.b)
select d.doc_id, coalesce(n.n, 0) n_shingles, min(r.root) component_id, d.doc_id = min(r.root) kept
from documents d left join n on n.doc_id = d.doc_id left join r on r.doc_id = d.doc_id group by d.doc_id, n.n
""",
    "op8_quality_rules": rf"""
with w as (select doc_id, coalesce(text, '') t, {_WORDS} w from documents),
g as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) p from w where len(w) >= 3)),
r as (select doc_id, p from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1),
c as (select doc_id, count(distinct q) n from (select doc_id, unnest([p, p + 1, p + 2]) q from r) group by 1),
l as (select doc_id, count(*) n, count(distinct line) d from (select doc_id, unnest(string_split(t, chr(10))) line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (
  select w.doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(l.n - l.d, 0)::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, coalesce(l.n, 0) n_lines
  from w left join c on c.doc_id = w.doc_id left join l on l.doc_id = w.doc_id),
f as (
  select *, (n_words < 50)::int b0, (100 * n_repeat_words > 50 * n_words)::int b1, (100 * n_symbols > 20 * word_chars)::int b2,
    (100 * n_dup_lines > 50 * n_lines)::int b3, (word_chars > 30 * n_words)::int b4, (word_chars < 2 * n_words)::int b5 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 + b1 > 0 base_failed, b0 + b1 + b2 + b3 + b4 + b5 = 0 kept,
  (b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5)::bigint fail_bits from f
""",
    "op10_decontamination": r"""
with low as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents, low),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark, low),
iw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from i where len(w) > 0)),
dw as (select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, p, dw.n, item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
x as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from h) group by 1),
y as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from h) group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join x on x.doc_id = d.doc_id left join y on y.doc_id = d.doc_id
""",
    "op11_prefix_trie": r"""
with t as (
  select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) k
  from conversations where conv_id is not null),
i as (
  select c, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: case when b % 2 = 1 then xor(b // 2, 3988292384) else b // 2 end)), 4294967295) % 9 h
  from (select c, count(*) n from t group by c)),
r as (
  select i.c, k d, role, text from i join t on t.c = i.c - i.c % 5 and t.k <= i.h
  union all select i.c, t.k - i.h + least(i.h, coalesce(j.n, 0)), role, text from i join t on t.c = i.c and t.k > i.h left join i j on j.c = i.c - i.c % 5),
m as (
  select c, d, strlen(text) b, string_agg(md5(length(role) || ':' || role || text), '') over (partition by c order by d) p from r
  union all select c, 0, 0, '' from i),
v as (select p, d, min(c) c, count(*) n, any_value(b) b from m group by p, d),
k as (select left(p, 32 * (d - 1)) p, count(*) n from v where d > 0 group by 1),
u as (select v.*, coalesce(k.n, 0) n_children from v left join k using (p)),
s as (select left(p, 32 * a) p, sum(case when n_children = 0 then 1 else 0 end) leaves, sum((n - 1) * b) saved from (select *, unnest(range(0, d + 1)) a from u) group by 1),
l as (select p, c from (select c, p, d, max(d) over (partition by c) m from m) where d = m),
e as (select p, string_agg(c::varchar, ',' order by c) ids from l group by p)
select u.c conv_id, u.d::bigint depth, w.c parent_conv_id, u.n::bigint n_convs, u.n_children::bigint n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
from u join s on s.p = u.p left join v w on u.d > 0 and w.p = left(u.p, 32 * (u.d - 1)) left join e on e.p = u.p
""",
    "op12_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50)),
f as (select g, min(doc_id) f from g group by 1),
r as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 50)) q from g join f using (g) where f < doc_id)),
k as (
  select e.doc_id, count(r.q) n, string_agg(e.x, ' ' order by e.q) filter (r.q is null) kept
  from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) q from d) e left join r on r.doc_id = e.doc_id and r.q = e.q group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(k.n, 0)::bigint n_removed, sha256(coalesce(k.kept, '')) kept_sha256 from d left join k on k.doc_id = d.doc_id
""",
    "op13_ball_search": r"""
with low as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents, low),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark, low),
c as (select count(*)::bigint n, sum(len(w))::bigint l from d where len(w) > 0),
m as (select doc_id, 100 - 25 + ((25 * len(w)::bigint * n) // l) m from d, c where len(w) > 0),
f as (select doc_id, t, count(*)::bigint tf from (select doc_id, unnest(w) t from d) group by 1, 2),
w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint w from (select t, count(*) df from f group by 1), c),
q as (select item_id, t, count(*)::bigint k from (select item_id, unnest(w) t from i) group by 1, 2),
s as (
  select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from q join f using (t) join w using (t) join m using (doc_id) group by 1, 2)
select item_id, rank::int rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0) where rank <= 20
""",
}
