"""The registered queries of this subpackage and their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmground.llm import (
    byte_bpe, decontam, divergence, exact_dedup, lines, near_dedup, packing, passages, pii, resampling, token_counts, tool_calls, toxicity,
)

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_exact_dedup", r"""
with n as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(body) as text_sha256
from n window w as (partition by body order by size desc, doc_id)""")
def op1(spark, folder):
    found = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_minhash_near_dedup")
def op7(spark, folder):
    return near_dedup.near_groups(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark, folder):
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op4_line_dedup", r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
d as (select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from d group by doc_id""")
def op4(spark, folder):
    found = lines.kept_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_spaced_seed_decontamination")
def op8(spark, folder):
    return decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_curve_packing")
def op6(spark, folder):
    import public_tokenizers

    found = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.drop("ids")


@query("op9_char_lstm_crf_pii")
def op9(spark, folder):
    found = pii.personal_data(table(spark, folder, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


@query("op3_compact_window_passages")
def op3(spark, folder):
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op5_tool_call_linking", """
with u as (select * from conversations where role = 'user'), a as (select * from conversations where role = 'assistant'),
e as (select u.*, exists (from u v where v.conv_id = u.conv_id and v.turn = u.turn - 2) as e2,
  exists (from u v where v.conv_id = u.conv_id and v.turn = u.turn - 4) as e4, exists (from u v where v.conv_id = u.conv_id and v.turn = u.turn - 6) as e6 from u),
c as (select e.conv_id, 'c' || e.conv_id || '-' || e.turn as call_id, e.turn, a.text as content, a.turn is not null as answered,
  (case when e.turn % 8 < 2 or not e2 then 0 when e.turn % 8 < 4 or not e4 then 1 when e.turn % 8 < 6 or not e6 then 2 else 3 end)::int as layer,
  '{"prompt":' || to_json(e.text)::varchar || ',"turn":' || e.turn || '}' as arguments, case when e.turn < 2 then 'ask' else 'follow_up' end as name
  from e left join a on a.conv_id = e.conv_id and a.turn = e.turn + 1),
o as (select a.conv_id, 'c' || a.conv_id || '-' || (a.turn - 1) as call_id, a.turn, a.text as content from a
  where not exists (from u where u.conv_id = a.conv_id and u.turn = a.turn - 1))
select conv_id, call_id, turn, layer, case when answered then 'ok' else 'unanswered' end as status, '' as problems,
  '{"arguments":' || arguments || ',"content":' || coalesce(to_json(content)::varchar, 'null') || ',"id":"' || call_id || '","name":"' || name || '","order":' || layer || '}' as line from c
union all select conv_id, call_id, turn, null, 'orphan', '', '{"arguments":null,"content":' || to_json(content)::varchar || ',"id":"' || call_id || '","name":null,"order":null}' from o""")
def op5(spark, folder):
    """Runs of eight turns and the turns of two roles, as its SQL has them; the operator takes whole conversations and all roles."""
    calls, results = tool_calls.from_turns(table(spark, folder, "conversations"), run=8)
    found = tool_calls.linked_calls(calls, results, tool_calls.reply_schemas(spark))
    return found.withColumn("problems", F.array_join("problems", "; "))


@query("op10_edit_aware_counts")
def op10(spark, folder):
    """Every document takes three edits whose places follow from its length and id: an insertion, a deletion, a replacement."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    n, spot = F.length(F.coalesce("text", F.lit(""))), F.pmod(F.xxhash64("doc_id"), F.lit(97))
    edit = lambda at, length, text: F.struct(F.floor(at).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(text).alias("replacement"))
    edits = F.array(edit(n * spot / 97, 0, " (see 12.5% of it)"), edit(n * (96 - spot) / 97, 7, ""), edit(n / 2, 3, "\n\nit's"))
    docs = table(spark, folder, "documents").withColumn("edits", edits)
    found = token_counts.edited_counts(token_counts.count_trees(docs, path, keep=["edits"]), path)
    return found.select("doc_id", "tokens_before", "n_tokens", "encoded")


#: The CRC-32 of a word by its reversed polynomial (a fixed value), byte by byte; DuckDB has no such function.
_CRC = r"""
with recursive steps as (select i as b, i as c, 0 as k from range(256) t(i)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by b) as tab from steps where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wd as (select doc_id, unnest(w) as word from d), wb as (select unnest(w) as word from b),
words as (select word, hex(word) as h from (select word from wd union select word from wb)),
hashed as (select word, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range(length(h) // 2)],
  lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 as bucket from words, crc)"""


@query("op11_importance_resampling", _CRC + r""",
s as (select bucket, count(*) as n from wd join hashed using (word) group by 1), t as (select bucket, count(*) as n from wb join hashed using (word) group by 1),
g as (select k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (coalesce((select sum(n) from s), 0) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double)))::bigint as gain
  from (select distinct bucket from hashed) k left join s on s.bucket = k.bucket left join t on t.bucket = k.bucket),
v as (select doc_id, sum(gain)::bigint as weight from wd join hashed using (word) join g using (bucket) group by doc_id),
x as (select d.doc_id, len(w) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join v using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from x where n_features >= 20)
select x.doc_id, n_features, weight, score, case when r.rank <= 10 * n // 100 then r.rank end as rank from x left join r using (doc_id)""")
def op11(spark, folder):
    found = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_byte_bpe")
def op12(spark, folder):
    """Every text is encoded, and its ids decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), path, offsets=False)
    found = byte_bpe.decode(encoded, path, keep=("doc_id", "n_tokens", "n_split", "ids"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"), "n_split")


@query("op13_source_divergence", r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
u as (select doc_id, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from u group by 1, 2 having count(distinct doc_id) >= 3),
v as (select l.lang, count(term) as v, coalesce(sum(n), 0) as total from (select distinct lang from d) l left join kept using (lang) group by 1),
g as (select distinct lang, source from d),
c as (select u.lang, source, term, count(*) as n from u join kept using (lang, term) group by 1, 2, 3),
t as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by 1, 2),
p as (select t.lang, t.source, kept.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + v.v) as p,
    1 + 1000000000::hugeint * (kept.n + 1) // (v.total + v.v) as q
  from t join v using (lang) join kept on kept.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from f)
select * from r where part = 'pair' or rank <= 200""")
def op13(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))
