"""Text queries over whole documents and conversations."""
from pyspark.sql import functions as F

from firmground.operators import texts as X
from firmground.plans.registry import query
from firmground.plans.scores import rounded


def lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


STOP = ", ".join(lit(w) for w in X.STOP_WORDS)


@query("tx01_keyword_groups", rf"""
with w as (select doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+')) as token from documents),
d as (select distinct doc_id, token from w where length(token) > 2 and token not in ({STOP})),
r as (select *, row_number() over (partition by token order by doc_id) as k from d)
select token, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) filter (k <= 3) as examples from r group by 1 having count(*) >= 3""")
def _(t):
    return X.keyword_groups(t.documents, "doc_id", "text")


TRACE = rf"""
with l as (select {{key}}, string_split(text, chr(10)) as l from {{table}}),
x as (select {{key}}, generate_subscripts(l, 1) as i, l from l),
c as (select {{key}}, len(regexp_extract_all(l[i], {lit(X.CLAIM)})) as c,
  regexp_matches(array_to_string(l[greatest(i - 2, 1):i + 2], chr(10)), {lit(X.REFERENCE)}) as e from x),
s as (select {{key}}, sum(c)::int as claims, sum(case when e then c else 0 end)::int as traced from c group by all)
select {{key}}, claims, traced, round(traced / nullif(claims, 0)::double, 6) as share, coalesce(traced / nullif(claims, 0)::double >= 0.9, true) as passed from s"""


def reports(t):
    """Documents rewritten as reports: every sentence a line, numbered ones carrying a claim or a reference."""
    lines = F.split(F.col("text"), r"\n")
    marked = F.transform(lines, lambda s, i: F.when(i % 7 == 2, F.concat(F.lit("lift = 1.25, up 4.5% "), s)).when(
        i % 11 == 5, F.concat(F.lit("source: output/run.csv "), s)).when(
        i % 5 == 1, F.concat(F.lit("- "), s, F.lit(" corr = 0.4"))).when(i % 5 == 3, F.concat(F.lit("* "), s)).otherwise(s))
    return t.documents.select("doc_id", F.array_join(marked, "\n").alias("text"))


REPORTS = """reports as (select doc_id, string_agg(case when i % 7 = 2 then 'lift = 1.25, up 4.5% ' || s when i % 11 = 5 then 'source: output/run.csv ' || s
  when i % 5 = 1 then '- ' || s || ' corr = 0.4' when i % 5 = 3 then '* ' || s else s end, chr(10) order by i) as text from
  (select doc_id, l[i + 1] as s, i from (select doc_id, string_split(text, chr(10)) as l, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)) group by 1)"""


@query("tx02_claim_trace", TRACE.replace("{key}", "doc_id").replace("{table}", "documents"))
def _(t):
    return rounded(X.claim_trace(t.documents, "doc_id", "text"), "share")


@query("tx02_claim_trace_reports", TRACE.replace("{key}", "doc_id").replace("{table}", "reports").replace("with ", f"with {REPORTS}, ", 1))
def _(t):
    return rounded(X.claim_trace(reports(t), "doc_id", "text"), "share")


SHARE = rf"""
with f as (select doc_id, regexp_extract_all(text, {lit(X.FINDING)}) as f from {{table}}),
s as (select doc_id, len(f)::int as findings, len([x for x in f if regexp_matches(x, {lit(X.EVIDENCE)})])::int as backed from f)
select doc_id, findings, backed, round(backed / nullif(findings, 0)::double, 6) as share, coalesce(backed / nullif(findings, 0)::double >= 0.8, true) as passed from s"""


@query("tx03_evidence_share", SHARE.replace("{table}", "documents"))
def _(t):
    return rounded(X.evidence_share(t.documents, "doc_id", "text"), "share")


@query("tx03_evidence_share_reports", SHARE.replace("{table}", "reports").replace("with ", f"with {REPORTS}, ", 1))
def _(t):
    return rounded(X.evidence_share(reports(t), "doc_id", "text"), "share")
