"""SQL of the registered queries for DuckDB, written with joins and windows over rows.

The SQL states each result on its own: relational steps over one row per paragraph, claim or
line, where the Spark side works on arrays. Only fixed values and the derived input texts
are shared.
"""

from __future__ import annotations

from docaudit import fixed as fx
from docaudit.functions.text import duck_regex
from docaudit.plans import inputs as src

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = q(fx.WS_CHARS)
RE_WS = duck_regex(r"\s")
NON_TOKEN = "[^" + fx.TOKEN_CLASS[1:-1] + "]+"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def trim(x):
    return f"trim({x}, {WS})"


def nl(x):
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def match(x, pattern, ci=True):
    return f"regexp_matches({x}, {q(duck_regex(pattern, ci))})"


def match_any(x, patterns):
    return "(" + " or ".join(match(x, p) for p in patterns) + ")"


def collapse(x):
    return trim(f"regexp_replace({x}, {q(RE_WS + '+')}, ' ', 'g')")


def spaces(x):
    return trim(f"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def claim_text(x):
    c = collapse(x)
    first = f"list_filter(string_split_regex({c}, '[。.!?]'), lambda s: trim(s) <> '')[1]"
    return f"coalesce(trim({first}), {c})"


def tokens(x, stop=()):
    words = f"string_split_regex(regexp_replace(lower({x}), {q(NON_TOKEN)}, ' ', 'g'), ' +')"
    keep = "len(t) >= 2" + (f" and not list_contains({arr(stop)}, t)" if stop else "")
    return f"list_filter({words}, lambda t: {keep})"


def claim_key(x):
    return f"trim(regexp_replace(lower({x}), {q(NON_TOKEN)}, ' ', 'g'))"


def cents(x):
    return f"floor(({x}) * 100 + 0.5) / 100"


def pct(x):
    return f"(cast(floor(greatest(0.0, {x}) * 100 + 0.5) as bigint) || '%')"


def seq(prefix, n):
    return f"('{prefix}_' || case when {n} < 10000 then lpad(cast({n} as varchar), 4, '0') else cast({n} as varchar) end)"


def headline(x):
    return claim_text(x)


def paragraphs_of(x):
    return f"list_filter(list_transform(string_split_regex({nl(x)}, '\n{{2,}}'), lambda t: {trim('t')}), lambda t: len(t) > 2)"


def query(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# ---- SHEET artifacts ------------------------------------------------------------------------

M = {k: q(v) for k, v in fx.MSG.items()}
SHEET = f"""
lines as (
  select doc_id, text,
    list_filter(list_transform(string_split({nl('text')}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') as ls
  from documents),
counted as (
  select doc_id, ls, len(ls) as n_rows,
    len(list_filter(ls, lambda x: {match('x', fx.SHEET_NUMERIC_ROW, False)})) as n_numeric,
    len(list_filter(ls, lambda x: {match('x', fx.SHEET_FORMULA_ROW, False)})) as n_formula,
    {match('text', fx.SHEET_SOURCE_WORD)} as has_source
  from lines),
sheet as (
  select doc_id, n_rows, ls as body,
    list_filter([
      'SHEET統計: rows=' || n_rows || ', paragraphs=' || len(ls) || ', numeric_rows=' || n_numeric,
      case when n_formula = 0 then {M['sheet_no_formula']} end,
      case when n_numeric = 0 then {M['sheet_no_numbers']} end,
      case when not has_source then {M['sheet_no_source']} end], lambda x: x is not null) as sig
  from counted),
p as (
  select doc_id, unnest(list_concat(body, sig)) as text, generate_subscripts(list_concat(body, sig), 1) as ord,
    len(body) as n_body
  from sheet)"""

CLAIMS = SHEET + f""",
cand as (select doc_id, ord, {claim_text('text')} as ct, len({trim('text')}) as chars from p),
good as (select *, {match_any('ct', fx.CLAIM_PATTERNS)} as likely from cand where chars >= 12 and len(ct) >= 12),
c as (
  select doc_id, row_number() over (partition by doc_id order by likely desc, ord) as n, ct as text, ord as para, likely
  from good
  union all
  select doc_id, row_number() over (partition by doc_id order by ord) as n, ct, ord, false
  from cand where len(ct) > 0 and doc_id not in (select doc_id from good))"""

AUDIT = CLAIMS + f""",
ct as (select doc_id, n, text, {tokens('text', fx.EVIDENCE_STOP_WORDS)} as toks from c),
pt as (select doc_id, ord, text, {tokens('text', fx.EVIDENCE_STOP_WORDS)} as toks from p),
pair as (
  select ct.doc_id, ct.n, pt.ord, pt.toks as ptoks, pt.text as ptext,
    case when len(ct.toks) = 0 then 0.0
      else cast(len(list_filter(ct.toks, lambda t: list_contains(pt.toks, t))) as double) / len(ct.toks) end as score
  from ct join pt using (doc_id)),
tops as (
  select *, row_number() over (partition by doc_id, n order by score desc, ord) as rk
  from pair where score >= 0.18 qualify rk <= 3),
per as (
  select doc_id, n, max(score) as best, count(*) filter (score >= 0.35) as strong, count(*) filter (score >= 0.18) as support
  from pair group by all),
topagg as (
  select doc_id, n, count(*) as n_top, list({seq('par', 'ord')} order by rk) as ids,
    sum(score) filter (rk = 1) as s1, sum(score) filter (rk = 2) as s2, sum(score) filter (rk = 3) as s3,
    flatten(list(ptoks)) as seen, bool_or({match('ptext', fx.QUANTITATIVE)}) as pq
  from tops group by all),
verdict as (
  select ct.doc_id, ct.n, ct.text, best, strong, support, coalesce(n_top, 0) as n_top, ids,
    case when n_top is null then 0.0 else ((0.0 + s1) + coalesce(s2, 0) + coalesce(s3, 0)) / n_top end as avg,
    case when len(toks) = 0 or n_top is null then 0.0
      else cast(len(list_filter(toks, lambda t: list_contains(seen, t))) as double) / len(toks) end as cov,
    {match('ct.text', fx.QUANTITATIVE)} as cq, coalesce(pq, false) as pq
  from ct join per using (doc_id, n) left join topagg using (doc_id, n)),
audit as (
  select *, case when n_top = 0 or best < 0.22 then 'no_evidence'
      when cov < 0.3 or strong = 0 then 'narrow_evidence'
      when cq and not pq then 'numbers_unsupported'
      when best < 0.58 or n_top < 2 then 'thin_evidence' end as code
  from verdict),
ev as (
  select *, case code when 'no_evidence' then 'HIGH' when 'thin_evidence' then 'LOW' else 'MEDIUM' end as severity,
    case when code = 'no_evidence' then [] else ids end as para_ids,
    case code
      when 'no_evidence' then replace({M['no_evidence']}, '{{best}}', {pct('best')})
      when 'narrow_evidence' then replace(replace({M['narrow_evidence']}, '{{avg}}', {pct('avg')}), '{{coverage}}', {pct('cov')})
      when 'numbers_unsupported' then {M['numbers_unsupported']}
      when 'thin_evidence' then replace({M['thin_evidence']}, '{{best}}', {pct('best')}) end as reason
  from audit where code is not null)"""

LOGIC = f""",
flags as (
  select doc_id, n, text,
    {match('text', fx.NUMBER, False)} as num,
    {match_any('lower(text)', fx.VAGUE)} as vague, {match_any('lower(text)', fx.ABSOLUTE)} as absolute,
    {match_any('lower(text)', fx.COMPARATIVE)} as comparative, {match_any('lower(text)', fx.COMPARATOR)} as comparator,
    {match_any('lower(text)', fx.CONDITION)} as cond
  from c),
hits as (
  select doc_id, n, text, list_filter([
    case when absolute and not cond then 'absolute_without_condition' end,
    case when vague and not num then 'vague_without_number' end,
    case when comparative and not comparator then 'comparison_without_baseline' end,
    case when not num and not cond and not comparator then 'no_number_condition_comparator' end,
    case when len({trim('text')}) < 45 and not num then 'short_without_number' end], lambda x: x is not null) as rules
  from flags),
lr as (
  select *, case when list_contains(rules, 'absolute_without_condition') then 'HIGH'
      when list_contains(rules, 'vague_without_number') or list_contains(rules, 'comparison_without_baseline') then 'MEDIUM'
      else 'LOW' end as severity,
    array_to_string(list_transform(rules, lambda r: case r
      {' '.join(f"when '{r}' then {M[r]}" for r in (
          'absolute_without_condition', 'vague_without_number', 'comparison_without_baseline',
          'no_number_condition_comparator', 'short_without_number'))} end), '; ') as reason
  from hits where len(rules) > 0)"""

RISKS = AUDIT + LOGIC + f""",
allr as (
  select doc_id, 0 as src, n as pos, severity, {M['evidence_title']} || {headline('text')} as title, reason,
    'claim_' || n as cid, len(para_ids) as n_paras, array_to_string(para_ids, '+') as pids from ev
  union all
  select doc_id, 1, n, severity, {M['logic_title']} || {headline('text')}, reason, 'claim_' || n, 0, '' from lr),
firsts as (
  select *, row_number() over (partition by doc_id, severity, title, reason order by src, pos) as dup
  from allr qualify dup = 1),
top as (
  select *, row_number() over (partition by doc_id order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, src, pos) as rank
  from firsts)"""

query("evidence_audit", f"with {AUDIT} select doc_id, 'claim_' || n as claim_id, severity, code, best as best_score, cov as coverage, array_to_string(para_ids, ',') as para_ids from ev")
query("evidence_scores", f"with {AUDIT} select doc_id, 'claim_' || n as claim_id, best as best_score, avg as avg_score, strong as strong_count, support as support_count from audit")
query("top_support", f"with {AUDIT} select doc_id, 'claim_' || n as claim_id, rk as rank, {seq('par', 'ord')} as para_id, score from tops")
query("token_coverage", f"with {AUDIT} select doc_id, 'claim_' || n as claim_id, cov as coverage from audit")
query("claims_rule_based", f"with {CLAIMS} select doc_id, n as ord, 'claim_' || n as claim_id, text, {seq('par', 'para')} as para_ids from c")
query("claim_headlines", f"with {CLAIMS} select doc_id, 'claim_' || n as claim_id, {headline('text')} as headline, {match_any('text', fx.CLAIM_PATTERNS)} as claim_like from c")
query("evidence_audit_corpus", f"""
with {SHEET},
bc as (select item_id, {claim_text('text')} as text from benchmark),
bt as (select item_id, text, {tokens('text', fx.EVIDENCE_STOP_WORDS)} as toks from bc),
bx as (select item_id, len(toks) as len, unnest(toks) as t from bt),
bcount as (select item_id, len, t, count(*) as cnt from bx group by all),
pt as (select doc_id, ord, text, {tokens('text', fx.EVIDENCE_STOP_WORDS)} as toks from p),
px as (select doc_id, ord, unnest(list_distinct(toks)) as t from pt),
pair as (select item_id, doc_id, ord, cast(sum(cnt) as double) / max(len) as score from px join bcount using (t) group by item_id, doc_id, ord),
per as (select item_id, max(score) as best, count(*) filter (score >= 0.35) as strong, count(*) filter (score >= 0.18) as support from pair group by all),
tops as (select *, row_number() over (partition by item_id order by score desc, doc_id, ord) as rk from pair where score >= 0.18 qualify rk <= 3),
topagg as (
  select item_id, count(*) as n_top, string_agg(tops.doc_id || ':' || {seq('par', 'tops.ord')}, ',' order by rk) as ids,
    flatten(list(toks)) as seen, bool_or({match('pt.text', fx.QUANTITATIVE)}) as pq
  from tops join pt on tops.doc_id = pt.doc_id and tops.ord = pt.ord group by all),
v as (
  select bt.item_id, coalesce(best, 0.0) as best, coalesce(strong, 0) as strong, coalesce(support, 0) as support,
    coalesce(n_top, 0) as n_top, coalesce(ids, '') as ids, {match('bt.text', fx.QUANTITATIVE)} as cq, coalesce(pq, false) as pq,
    case when n_top is null then 0.0 else cast(len(list_filter(bt.toks, lambda t: list_contains(seen, t))) as double) / len(bt.toks) end as cov
  from bt left join per using (item_id) left join topagg using (item_id))
select item_id, best as best_score, cov as coverage, strong as strong_count, support as support_count, ids as support,
  case when n_top = 0 or best < 0.22 then 'HIGH' when cov < 0.3 or strong = 0 then 'MEDIUM'
    when cq and not pq then 'MEDIUM' when best < 0.58 or n_top < 2 then 'LOW' else 'NONE' end as severity
from v""")

CAND = SHEET + f""",
raw as (
  select doc_id, ord, cast(floor((ord - 1) / 100) as bigint) + 1 as segment, {claim_text('text')} as text,
    list_filter([case when regexp_matches(text, '[0-9]') then 'par_none' else {seq('par', 'ord')} end, 'par_0001'], lambda x: x <> 'par_none') as ids
  from p),
sc as (
  select *, {cents(f"(case when {match_any('text', fx.CLAIM_PATTERNS)} then 2.0 else 0.0 end) + (case when regexp_matches(text, '[0-9]') then 1.0 else 0.0 end) + (case when {match('text', fx.CANDIDATE_CUE)} then 1.0 else 0.0 end) + least(2.0::double, len(ids) * 0.5::double) + least(2.0::double, cast(len(text) as double) / 120)")} as score
  from raw where len(text) >= 12),
keyed as (select *, {claim_key('text')} as key from sc),
best as (
  select doc_id, key, min((segment, ord)) as place, arg_max((text, ids, score), (score, -segment, -ord)) as b
  from keyed group by all),
ranked as (
  select doc_id, row_number() over (partition by doc_id order by b[3] desc, place) as ord, b[1] as text, b[3] as score
  from best)"""
query("claim_scores", f"with {CAND} select doc_id, ord, text, array_to_string(ids, ',') as para_ids, score from sc")
query("claim_dedupe_best", f"with {CAND} select doc_id, ord, text, score from ranked")
query("claim_merge_fallback", f"""
with {CAND}, {CLAIMS[len(SHEET) + 1:]},
u as (
  select doc_id, ord, text, 0 as src from ranked
  union all select doc_id, n, text, 1 from c),
k as (select *, lower({collapse('lower(text)')}) as tk from u),
d as (select *, row_number() over (partition by doc_id, tk order by src, ord) as dup from k),
f as (select doc_id, text, src, ord as o from d where src = 0 or dup = 1)
select doc_id, row_number() over (partition by doc_id order by src, o) as ord, text from f""")

QUALITY = f""",
qc as (
  select c.doc_id, c.n, c.text, c.para, {claim_text('c.text')} as norm, {tokens(claim_text('c.text'))} as lt, {tokens('p.text')} as rt
  from c join p on p.doc_id = c.doc_id and p.ord = c.para),
qf as (
  select *, len(norm) >= 20 as f1, {match_any('norm', fx.CLAIM_PATTERNS)} as f2, regexp_matches(norm, '[0-9]') as f3,
    {match('norm', fx.CONDITION_CUE)} as f4,
    case when len(lt) = 0 then false else cast(len(list_filter(lt, lambda t: list_contains(rt, t))) as double) / len(lt) >= 0.3 end as f5
  from qc),
qs as (
  select doc_id, n, text, para, {claim_key('text')} as key,
    (60 + f1::int * 100 + f2::int * 100 + f3::int * 80 + f4::int * 70 + f5::int * 100) / 100.0::double as quality,
    list_filter([case when not f1 then 'too_short' end, case when not f2 then 'not_claim_like' end, case when not f3 then 'no_number' end,
      case when not f4 then 'no_condition_or_comparator' end, case when not f5 then 'low_source_overlap' end], lambda x: x is not null) as issues
  from qf)"""
query("claim_quality", f"with {CLAIMS}{QUALITY} select doc_id, 'claim_' || n as claim_id, quality, array_to_string(issues, ',') as issues from qs")
query("claim_duplicates", f"with {CLAIMS} select doc_id, {claim_key('text')} as key, count(*) as n, min(c.n) as first_ord from c group by 1, 2 having count(*) > 1")


def refine_round(i: int) -> str:
    """One replacement round over cur{i-1}; the pool is fixed."""
    a, b = f"cur{i - 1}", f"cur{i}"
    return f""",
w{i} as (
  select *, (quality < 2.2 or n_issues >= 2) or row_number() over (partition by doc_id, key order by quality desc, place) > 1 as repl
  from {a}),
need{i} as (select doc_id, count(*) filter (repl) as need from w{i} group by all),
av{i} as (
  select pool.*, row_number() over (partition by pool.doc_id order by quality desc, pord) as rk
  from pool where not exists (select 1 from w{i} where w{i}.doc_id = pool.doc_id and w{i}.key = pool.key and not repl)),
tk{i} as (select av{i}.* from av{i} join need{i} using (doc_id) where rk <= need),
has{i} as (select distinct doc_id from tk{i}),
{b} as (
  select doc_id, place, text, para, quality, n_issues, key from w{i} where not repl or doc_id not in (select doc_id from has{i})
  union all select doc_id, {i * 100000} + rk, text, para, quality, n_issues, key from tk{i})"""


REFINED = CLAIMS.replace("\nc as (", "\nc0 as (") + QUALITY.replace("from c join p", "from c0 c join p") + f""",
pool as (
  select *, n as pord, len(issues) as n_issues from qs where key <> ''
  qualify row_number() over (partition by doc_id, key order by n) = 1),
cur0 as (select doc_id, n as place, text, para, quality, len(issues) as n_issues, key from qs)
{refine_round(1)}{refine_round(2)},
c as (select doc_id, row_number() over (partition by doc_id order by place) as n, text, para, quality, n_issues from cur2)"""
REPORT = f""",
rounds as (
  select doc_id, need1.need as n1, need2.need as n2, (select count(*) from tk1 where tk1.doc_id = need1.doc_id) as t1,
    (select count(*) from tk2 where tk2.doc_id = need1.doc_id) as t2 from need1 join need2 using (doc_id)),
report as (
  select doc_id, case when n1 = 0 or t1 = 0 then 1 else 2 end as iterations, t1 + case when n1 = 0 or t1 = 0 then 0 else t2 end as replacements,
    (select count(*) from cur2 where cur2.doc_id = rounds.doc_id and (quality < 2.2 or n_issues >= 2)) as weak_claims,
    case when n1 > 0 and t1 = 0 then {q(fx.MSG['refiner_empty'].replace('{n}', '1'))} when n1 > 0 and n2 > 0 and t2 = 0 then {q(fx.MSG['refiner_empty'].replace('{n}', '2'))} else '' end as warnings
  from rounds)"""
query("claim_refine", f"with {REFINED} select doc_id, n as ord, text, quality, n_issues as issues from c")
query("refine_report", f"with {REFINED}{REPORT} select * from report")

SEGMENTS = SHEET + f""",
sp as (
  select doc_id, ord, ord > n_body as sig, row_number() over (partition by doc_id, ord > n_body order by ord) - 1 as i,
    count(*) over (partition by doc_id, ord > n_body) as cnt, {collapse('text')} as ptext
  from p where len({collapse('text')}) >= 12)"""


def segments(size: int, overlap: int) -> str:
    step = size - overlap
    return SEGMENTS + f""",
chunk as (
  select doc_id, sig, ord, ptext, k from sp, lateral (select unnest(range(0, greatest(0, cast(ceil((cnt - {size}) / {step}.0) as bigint)) + 1)) as k) x
  where i >= k * {step} and i < k * {step} + {size}),
numbered as (select *, dense_rank() over (partition by doc_id order by sig, k) - 1 as basis from chunk),
placed as (select doc_id, ord, ptext, basis as seg, row_number() over (partition by doc_id, basis order by ord) as o from numbered)"""


query("segments_overlap", f"with {segments(12, 3)} select doc_id, seg + 1 as segment, o as ord, {seq('par', 'ord')} as para_id from placed")
PROMPT_HEAD = "\n".join(
    ["タスク: 文書から主要な主張(claim)を抽出する。", *fx.COMMON_PROMPT_RULES, "出力スキーマ:",
     '{ "claims": [{ "claimId": "...", "text": "...", "paragraphIds": ["..."], "confidence": "low|medium|high" }] }', "最大件数: "]
)
query("claim_prompts", f"""
with {segments(120, 24)},
segs as (select doc_id, seg, string_agg('[' || {seq('par', 'ord')} || '] ' || ptext, chr(10) order by o) as body from placed group by all),
n as (select *, greatest(4, least(14, cast(ceil(36.0 / count(*) over (partition by doc_id)) as bigint) + 2)) as m from segs),
t as (select *, {q(PROMPT_HEAD)} || m || chr(10) || '注意: claim.text は元文の意味を維持し、冗長にしない。' || chr(10) || '入力文書:' || chr(10) || body as prompt from n)
select doc_id, seg + 1 as segment, m as max_claims, len(prompt) as chars, md5(prompt) as digest from t""")
query("model_output_check", """
select doc_id, lang <> 'de' and (lang in ('fr', 'es') or source <> 'src3') and len(text) > 0 as valid from documents""")

query("logic_risks", f"with {CLAIMS}{LOGIC} select doc_id, 'claim_' || n as claim_id, array_to_string(rules, ',') as rules, severity from lr")
query("prior_art", f"""
with {CLAIMS},
k as (
  select doc_id, n, u.t as t, min(u.i) as i from c, lateral (
    select unnest({tokens('text', fx.KEYWORD_STOP_WORDS)}) as t, generate_subscripts({tokens('text', fx.KEYWORD_STOP_WORDS)}, 1) as i) u group by all),
r as (select *, row_number() over (partition by doc_id, n order by i) as rk from k)
select c.doc_id, 'claim_' || c.n as claim_id, coalesce(string_agg(t, ' ' order by rk), '{' '.join(fx.DEFAULT_KEYWORDS)}') as query
from c left join r on c.doc_id = r.doc_id and c.n = r.n group by c.doc_id, c.n""")
query("quality_gate", f"""
with {SHEET}
select doc_id, count(*) as paragraphs, sum(len(text))::bigint as chars, cast(floor(sum(len(text)) / count(*) + 0.5) as bigint) as mean_chars,
  count(*) >= 6 and sum(len(text)) >= 700 as passed from p group by doc_id""")
query("signal_counts", f"""
with {AUDIT}{LOGIC},
s as (
  select doc_id, case when len(para_ids) = 0 then 'N' else 'W' end as k from ev
  union all select doc_id, case when severity in ('HIGH', 'MEDIUM') then 'S' else 'W' end from lr)
select d.doc_id, count(*) filter (k = 'N') as no_evidence_claims, count(*) filter (k = 'W') as weak_evidence_claims, count(*) filter (k = 'S') as specificity_lack
from documents d left join s using (doc_id) group by all""")
query("top_risks", f"with {RISKS} select doc_id, rank, severity, title, reason, cid as claim_ids from top")
query("severity_histogram", f"with {RISKS} select d.doc_id, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low from documents d left join top using (doc_id) group by all")
query("risk_split", f"with {RISKS} select doc_id, rank, case when rank <= 3 then 'top3' else 'next5' end as part, 1 as n_claims, n_paras as n_paragraphs, 0 as n_citations from top where rank <= 8")
query("claim_evidence_view", f"""
with {AUDIT}
select c.doc_id, 'claim_' || c.n as claim_id, coalesce(severity, 'LOW') as severity,
  case coalesce(severity, 'LOW') when 'HIGH' then 'none' when 'MEDIUM' then 'weak' else 'moderate' end as strength,
  case when code is null then {seq('par', 'c.para')} else array_to_string(para_ids, ',') end as para_ids,
  coalesce(reason, {M['no_evidence_risk']}) as reason
from c left join ev on c.doc_id = ev.doc_id and c.n = ev.n""")
query("claims_with_logic", f"with {CLAIMS}{LOGIC} select c.doc_id, 'claim_' || c.n as claim_id, coalesce(severity, 'NONE') as logic_severity from c left join lr on c.doc_id = lr.doc_id and c.n = lr.n")
query("audit_by_label", f"""
with {AUDIT}
select quality, case when code is null then 'NONE' when code = 'no_evidence' then 'HIGH' when code = 'thin_evidence' then 'LOW' else 'MEDIUM' end as severity, count(*) as claims
from audit join labels using (doc_id) group by all""")
query("vague_points", f"""
with {RISKS}
select doc_id, 'logic_risk_' || row_number() over (partition by doc_id order by n) as point_id, 'claim_' || n || ': ' || reason as text, 'no_condition' as type from lr
union all select doc_id, 'risk_vague_' || rank, title || ': ' || reason, 'no_condition' from top where doc_id not in (select doc_id from lr)""")
query("todos", f"""
with {RISKS}
select doc_id, 'todo_risk_' || rank as todo_id, title, case severity when 'HIGH' then 5 when 'MEDIUM' then 4 else 3 end as impact, 2 as effort, 'pending' as status from top
union all select c.doc_id, 'todo_claim_' || c.n, 'Claim ' || c.n || ' の根拠を補強', 3, 2, 'pending' from c where c.doc_id not in (select doc_id from top)""")
query("heatmap_text", f"with {CLAIMS} select doc_id, string_agg(text, chr(10) order by n) as text from c group by all")
query("claim_context", f"with {CLAIMS} select doc_id, string_agg('[claim_' || n || '] ' || text, chr(10) order by n) as context, min(text) filter (n = 1) as first_claim from c group by all")
query("sheet_paragraphs", f"with {SHEET} select doc_id, ord, {seq('par', 'ord')} as para_id, case when ord > n_body then 'sec_0002' else 'sec_0001' end as section_id, text from p")
query("sheet_signals", f"with {SHEET} select doc_id, n_rows, n_numeric, n_formula, has_source from counted")

# ---- DOC artifacts: one row per line, blocks as islands ------------------------------------------

HEAD_MD = duck_regex(r"^(#{1,6})\s+(\S.*)$").replace("\\S", "[^" + duck_regex(r"\s")[1:])
HEAD_NUM = duck_regex(r"^(\d{1,2}(?:\.\d{1,2})*)\s+(.+)$")
DOC = f"""
t as (select doc_id, {src.DOC_TEXT} as text from documents),
l as (select doc_id, unnest(string_split({nl('text')}, chr(10))) as line, generate_subscripts(string_split({nl('text')}, chr(10)), 1) as i from t),
h as (
  select *, case when regexp_matches(line, {q(HEAD_MD)}) then 1 when regexp_matches(line, {q(HEAD_NUM)}) then 2 else 0 end as kind,
    {trim('line')} = '' as blank from l),
g as (
  select *,
    case kind when 1 then {trim(f"regexp_extract(line, {q(HEAD_MD)}, 2)")} when 2 then {trim(f"regexp_extract(line, {q(HEAD_NUM)}, 2)")} end as title,
    case kind when 1 then len(regexp_extract(line, {q(HEAD_MD)}, 1))
      when 2 then least(6, len(regexp_replace(regexp_extract(line, {q(HEAD_NUM)}, 1), '[^.]', '', 'g')) + 1) end as level,
    sum(case when kind > 0 or blank then 1 else 0 end) over (partition by doc_id order by i) as island
  from h),
secs as (
  select doc_id, title, level, i from g where kind > 0 and title <> ''
  qualify row_number() over (partition by doc_id, lower(title) order by i) = 1),
seco as (select *, row_number() over (partition by doc_id order by i) as ord from secs),
cur as (select *, last_value(case when kind > 0 then title end ignore nulls) over (partition by doc_id order by i) as now from g),
blocks as (
  select doc_id, island, {trim("string_agg(line, chr(10) order by i)")} as text, any_value(now) as title
  from cur where kind = 0 and not blank group by doc_id, island),
numbered as (select doc_id, title, text, row_number() over (partition by doc_id order by island) as ord from blocks where text <> ''),
stat as (
  select doc_id, lower(text) as low, (select count(*) from seco s where s.doc_id = t.doc_id) as n_sections,
    (select count(*) from numbered b where b.doc_id = t.doc_id) as n_paras from t),
sig as (
  select doc_id, n_sections, n_paras, {match('low', fx.DOC_EVIDENCE_WORD)} as has_evidence, {match('low', fx.DOC_DECISION_WORD)} as has_decision,
    {match('low', fx.DOC_RISK_WORD)} as has_risk, {match('low', fx.DOC_ASSUMPTION_WORD)} as has_assumption from stat),
sigp as (
  select doc_id, n_paras, n_sections, list_filter(['DOC統計: sections=' || n_sections || ', paragraphs=' || n_paras,
    case when not has_evidence then {M['doc_no_evidence']} end, case when not has_decision then {M['doc_no_decision']} end,
    case when not has_risk then {M['doc_no_risk']} end, case when not has_assumption then {M['doc_no_assumption']} end], lambda x: x is not null) as s from sig)"""
query("doc_sections", f"""
with {DOC}
select doc_id, ord, {seq('sec', 'ord')} as section_id, title, level from seco
union all select doc_id, n_sections + 1, {seq('sec', '(n_sections + 1)')}, 'Artifact Signals', 2 from sigp""")
query("markdown_sections", f"""
with {DOC}
select b.doc_id, b.ord, case when s.ord is not null then {seq('sec', 's.ord')} end as section_id, b.text
from numbered b left join seco s on s.doc_id = b.doc_id and s.title = b.title
union all
select doc_id, n_paras + generate_subscripts(s, 1), {seq('sec', '(n_sections + 1)')}, unnest(s) from sigp""")
query("doc_signals", f"with {DOC} select doc_id, n_sections, n_paras, has_evidence, has_decision, has_risk, has_assumption from sig")

# ---- LaTeX ------------------------------------------------------------------------------------------

SEC = r"\\(subsubsection|subsection|section)\{([^}]*)\}"
FIG = r"(?s)\\begin\{figure\}.*?\\end\{figure\}"


def pieces(table: str, col: str, pattern: str, out: str) -> str:
    """Pieces between matches with their offsets, as rows (doc_id, i, piece, m, off)."""
    return f"""
{out}_x as (
  select doc_id, unnest(string_split_regex({col}, {q(pattern)})) as piece, generate_subscripts(string_split_regex({col}, {q(pattern)}), 1) as i,
    list_concat(regexp_extract_all({col}, {q(pattern)}), ['']) as ms
  from {table}),
{out} as (
  select doc_id, i, piece, ms[i] as m,
    coalesce(sum(len(piece) + len(ms[i])) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from {out}_x)"""


CUT = r"(^|[^\\])%[^\n]*"
LATEX = f"""
t as (select doc_id, regexp_replace({nl(src.LATEX_SOURCE)}, {q(CUT)}, '\\1', 'g') as source, lang, source as src_name from documents),
{pieces('t', 'source', SEC, 'sx')},
sec as (
  select doc_id, off + len(piece) as start, {spaces(f"regexp_extract(m, {q(SEC)}, 2)")} as title,
    case regexp_extract(m, {q(SEC)}, 1) when 'section' then 1 when 'subsection' then 2 else 3 end as level
  from sx where m <> '' and regexp_extract(m, {q(SEC)}, 2) <> ''),
seco as (select *, row_number() over (partition by doc_id order by start) as ord from sec),
{pieces('t', 'source', chr(10) + '{2,}', 'cx')},
chunk as (
  select doc_id, i, {trim('piece')} as text, off + len(piece) - len(ltrim(piece, {WS})) as start from cx where {trim('piece')} <> '')"""
LREF = f"""lref as (
  select distinct doc_id, ord, para_id, {trim('r')} as label from (
    select doc_id, ord, para_id, unnest(regexp_extract_all(text, '\\\\(?:ref|autoref|eqref)\\{{([^}}]*)\\}}', 1)) as r from paras) where {trim('r')} <> '')"""
NREF = f"""nref as (select distinct doc_id, ord, para_id, unnest(regexp_extract_all(text, {q(duck_regex(chr(92) + 'b(?:Fig' + chr(92) + '.?|Figure)' + chr(92) + 's*(' + chr(92) + 'd+)' + chr(92) + 'b', True))}, 1)) as num from paras)"""
PAPER = LATEX + f""",
{pieces('t', 'source', FIG, 'fx')},
m1 as (select doc_id, string_agg(piece || repeat(chr(10), len(m)), '' order by i) as source from fx group by all),
{pieces('m1', 'source', SEC, 'mx')},
m2 as (select doc_id, string_agg(piece || repeat(' ', len(m)), '' order by i) as source from mx group by all),
{pieces('m2', 'source', chr(10) + '{2,}', 'px')},
pc as (
  select doc_id, i, {spaces(f"regexp_replace({trim('piece')}, {q(RE_WS + '*' + chr(10) + RE_WS + '*')}, ' ', 'g')")} as text,
    off + len(piece) - len(ltrim(piece, {WS})) as start
  from px where {trim('piece')} <> ''),
para as (select *, row_number() over (partition by doc_id order by i) as ord from pc where text <> ''),
paras as (
  select para.doc_id, para.ord, {seq('p', 'para.ord')} as para_id, case when seco.ord is not null then {seq('sec', 'seco.ord')} end as section_id, para.text
  from para asof left join seco on para.doc_id = seco.doc_id and para.start >= seco.start),
figs as (
  select doc_id, generate_subscripts(regexp_extract_all(source, {q(FIG)}), 1) as ord, unnest(regexp_extract_all(source, {q(FIG)})) as block from t),
fig as (
  select doc_id, ord, {seq('fig', 'ord')} as figure_id, {trim("regexp_extract(block, '\\\\label\\{([^}]*)\\}', 1)")} as label,
    {spaces("regexp_extract(block, '\\\\caption\\{([^}]*)\\}', 1)")} as caption from figs),
{LREF},
{NREF},
cite as (
  select distinct doc_id, ord, para_id, {trim('k')} as key from (
    select doc_id, ord, para_id, unnest(string_split(array_to_string(regexp_extract_all(text, '\\\\cite[a-zA-Z*]*\\{{([^}}]*)\\}}', 1), ','), ',')) as k from paras) where {trim('k')} <> ''),
bib as (
  select doc_id, 1 as ord, lang as key from t union all select doc_id, 2, 'key_' || src_name from t union all select doc_id, 3, 'unused_' || src_name from t)"""
K = fx.PREFLIGHT_KINDS


def message(kind, x):
    return f"replace({q(K[kind][1])}, '{{x}}', {x})"


FINDINGS = PAPER + f""",
fcount as (select doc_id, count(*) as n from fig group by all),
found as (
  select f.doc_id, 1 as k, f.ord as a, '' as b, 'MISSING_FIGURE_REFERENCE' as kind, 'error' as severity, {message('MISSING_FIGURE_REFERENCE', 'f.label')} as message, '' as paragraph_ids
  from fig f where not exists (select 1 from lref r where r.doc_id = f.doc_id and lower(r.label) = lower(f.label))
  union all
  select r.doc_id, 2, min(r.ord), r.label, 'UNKNOWN_FIGURE_REFERENCE', 'error', {message('UNKNOWN_FIGURE_REFERENCE', 'r.label')}, string_agg(para_id, ',' order by r.ord)
  from lref r where not exists (select 1 from fig f where f.doc_id = r.doc_id and f.label = r.label) group by r.doc_id, r.label
  union all
  select r.doc_id, 3, min(r.ord), r.num, 'UNKNOWN_FIGURE_REFERENCE', 'warning', {message('UNKNOWN_FIGURE_NUMBER', 'r.num')}, string_agg(para_id, ',' order by r.ord)
  from nref r join fcount using (doc_id) where try_cast(r.num as double) < 1 or try_cast(r.num as double) > n group by r.doc_id, r.num
  union all
  select c.doc_id, 4, min(c.ord), c.key, 'MISSING_BIB_ENTRY', 'error', {message('MISSING_BIB_ENTRY', 'c.key')}, string_agg(para_id, ',' order by c.ord)
  from cite c where not exists (select 1 from bib b where b.doc_id = c.doc_id and b.key = c.key) group by c.doc_id, c.key
  union all
  select b.doc_id, 5, b.ord, '', 'UNCITED_BIB_ENTRY', 'warning', {message('UNCITED_BIB_ENTRY', 'b.key')}, ''
  from bib b where not exists (select 1 from cite c where b.doc_id = c.doc_id and b.key = c.key)),
fo as (select *, row_number() over (partition by doc_id order by k, a, b) as n from found)"""
query("paragraph_offsets", f"with {LATEX} select doc_id, row_number() over (partition by doc_id order by i) as ord, start, start + len(text) as \"end\", md5(text) as digest from chunk")
query("block_paragraph_offsets", f"with {LATEX} select doc_id, row_number() over (partition by doc_id order by i) as ord, start, start + len(text) as \"end\", md5(text) as digest from chunk")
query("latex_sections", f"with {LATEX} select doc_id, {seq('sec', 'ord')} as section_id, title, level, start from seco")
query("section_asof", f"with {LATEX} select c.doc_id, c.start, case when s.ord is null then '-' else {seq('sec', 's.ord')} end as section_id from chunk c asof left join seco s on c.doc_id = s.doc_id and c.start >= s.start")
query("latex_paragraphs", f"with {PAPER} select doc_id, para_id, section_id, text from paras")
query("figure_mentions", f"""
with {PAPER}
select f.doc_id, f.figure_id, f.label, f.caption, coalesce(string_agg(r.para_id, ',' order by r.ord), '') as mentioned_in
from fig f left join (select distinct doc_id, ord, para_id, lower(label) as k from lref) r on r.doc_id = f.doc_id and r.k = lower(f.label)
group by all""")
query("latex_citations", f"with {PAPER} select doc_id, para_id, key from cite")
query("preflight_findings", f"with {FINDINGS} select doc_id, {seq('pf', 'n')} as finding_id, kind, severity, message, paragraph_ids from fo")
query("preflight_summary", f"with {FINDINGS} select doc_id, count(*) filter (severity = 'error') as error_count, count(*) filter (severity <> 'error') as warning_count from fo group by all")
query("preflight_todos", f"with {FINDINGS} select doc_id, {seq('pf', 'n')} as todo_id, kind as title, message as description, case severity when 'error' then 5 else 3 end as impact, 2 as effort from fo")
query("missing_citations", f"with {PAPER} select c.doc_id, c.key, string_agg(para_id, ',' order by ord) as para_ids from cite c where not exists (select 1 from bib b where b.doc_id = c.doc_id and b.key = c.key) group by all")
query("uncited_bib", f"with {PAPER} select doc_id, ord, key from bib b where not exists (select 1 from cite c where b.doc_id = c.doc_id and b.key = c.key)")
query("unknown_figure_refs", f"with {FINDINGS} select doc_id, b as ref, paragraph_ids as para_ids from found where k in (2, 3)")

# ---- pull requests --------------------------------------------------------------------------------------

FILE = duck_regex(r"^diff --git\s+a/.+\s+b/(.+)$")
PR = f"""
t as (select doc_id, {trim(nl(src.PR_TEXT))} as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t),
f as (
  select *, regexp_matches(line, {q(FILE)}) as is_file, starts_with(line, '@@') as is_hunk,
    case when regexp_matches(line, {q(FILE)}) then regexp_extract(line, {q(FILE)}, 1) end as path from l),
g as (
  select *, last_value(path ignore nulls) over (partition by doc_id order by i) as now,
    sum(is_hunk::int) over (partition by doc_id order by i) as h,
    sum((is_file or is_hunk)::int) over (partition by doc_id order by i) as cut,
    last_value(case when is_file then 0 when is_hunk then 1 end ignore nulls) over (partition by doc_id order by i) as inside from f),
hl as (
  select *, case when starts_with(line, '+') and not starts_with(line, '+++') then 'a' when starts_with(line, '-') and not starts_with(line, '---') then 'r'
    when starts_with(line, ' ') or {trim('line')} <> '' then 'c' end as kind
  from g where inside = 1 and not is_hunk and not is_file),
hh as (select doc_id, h as ord, coalesce(now, 'unknown') as path, line as header from g where is_hunk),
body as (
  select doc_id, h, list(substr(line, 2) order by i) filter (kind = 'a') as added, list(substr(line, 2) order by i) filter (kind = 'r') as removed,
    list(regexp_replace(line, '^ ', '') order by i) filter (kind = 'c') as context from hl group by all),
hunk as (
  select hh.doc_id, hh.ord, hh.path, hh.header, coalesce(added, []) as added, coalesce(removed, []) as removed, coalesce(context, []) as context
  from hh left join body on hh.doc_id = body.doc_id and hh.ord = body.h)"""


def preview(x):
    clean = f"list_filter(list_transform({x}, lambda v: {spaces('v')}), lambda v: v <> '')"
    return f"case when len({clean}) = 0 then '(none)' else array_to_string({clean}, ' ; ') end"


SUMMARY = (
    f"'Diff Hunk ' || ord || ': file=' || path || ' | header=' || header || ' | added(' || len(added) || ')=' || {preview('added')}"
    f" || ' | removed(' || len(removed) || ')=' || {preview('removed')} || ' | context=' || {preview('context')}"
)
query("diff_hunks", f"with {PR} select doc_id, ord, path, header, len(added) as added, len(removed) as removed, len(context) as context, {SUMMARY} as summary from hunk")

RULES = {r[0]: r for r in fx.DIFF_RISK_RULES}
NAMES = "list_filter(flatten(list_transform(adds, lambda a: [" + ", ".join(
    f"regexp_extract({spaces('a')}, {q(duck_regex(p))}, 1)" for p in fx.CHANGED_NAME_PATTERNS
) + "])), lambda n: n <> '')"


def distinct_in_order(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def listed(x):
    return f"array_to_string({x}, ', ')"


PRSIG = PR + f""",
d as (
  select doc_id, count(*) as n_hunks, list(path order by ord) as ps, flatten(list(added order by ord)) as adds, flatten(list(removed order by ord)) as rems
  from hunk group by all),
e as (select *, {distinct_in_order('ps')} as files, {NAMES} as ns from d),
x as (
  select e.*, t.text,
    list_filter(files, lambda v: {match('v', fx.CODE_FILE)}) as code, list_filter(files, lambda v: {match('v', fx.TEST_FILE)}) as tests,
    list_filter(files, lambda v: {match('v', fx.MIGRATION_FILE)}) as mig, list_filter(files, lambda v: {match('v', fx.SECURITY_FILE)}) as secu,
    {', '.join(f"len(list_filter(adds, lambda v: {match('v', r[2], r[3])})) as n_{i}" for i, r in RULES.items())},
    len(list_filter(rems, lambda v: {match('v', fx.REMOVED_ASSERTION, False)})) as n_assert, {distinct_in_order('ns')} as names
  from e join t using (doc_id)),
sg as (
  select doc_id, list_filter([
    {{'text': 'PR統計: files=' || len(files) || ', hunks=' || n_hunks || ', added=' || len(adds) || ', removed=' || len(rems), 'warning': ''}},
    {{'text': 'テスト信号: code_files=' || len(code) || ', test_files=' || len(tests), 'warning': case when len(code) > 0 and len(tests) = 0 then {M['pr_no_tests']} else '' end}},
    {{'text': case when len(secu) > 0 then 'セキュリティ関連ファイル変更: ' || {listed('secu')} end, 'warning': {M['pr_security']}}},
    {{'text': case when len(mig) > 0 then 'スキーマ変更ファイル: ' || {listed('mig')} end, 'warning': case when {match('text', fx.MIGRATION_WORD)} then '' else {M['pr_migration']} end}},
    {{'text': case when len(adds) + len(rems) >= 1200 then '大規模差分: total_lines=' || (len(adds) + len(rems)) end, 'warning': {M['pr_large']}}},
    {', '.join("{'text': case when n_%s > 0 then 'リスク信号(%s): %s (count=' || n_%s || ')' end, 'warning': %s}" % (i, i, r[1], i, q(r[1] + fx.MSG['pr_risk_suffix'])) for i, r in RULES.items())},
    {{'text': case when n_assert > 0 then '検証削除信号: assertion-like lines removed count=' || n_assert end, 'warning': {M['pr_assertions']}}},
    {{'text': case when len(names) > 0 then '変更関数候補: ' || {listed('names')} end, 'warning': ''}}
    ], lambda s: s['text'] is not null) as s from x)"""
query("pr_signals", f"with {PRSIG}, o as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) as ord from sg) select doc_id, ord, s['text'] as text, s['warning'] as warning from o")

LABEL = duck_regex(r"^([A-Za-z][A-Za-z0-9 _\-/]{2,40}):\s*$")
PRTEXT = PRSIG + f""",
hd as (
  select *, case when regexp_matches(line, {q(HEAD_MD)}) then {trim(f"regexp_extract(line, {q(HEAD_MD)}, 2)")}
      when regexp_matches(line, {q(LABEL)}) then {trim(f"regexp_extract(line, {q(LABEL)}, 1)")} end as title,
    case when regexp_matches(line, {q(HEAD_MD)}) then len(regexp_extract(line, {q(HEAD_MD)}, 1)) else 2 end as level,
    starts_with(line, 'diff --git ') or starts_with(line, '@@ ') as flush from l),
isl as (
  select *, last_value(case when title is not null then title end ignore nulls) over (partition by doc_id order by i) as now,
    last_value(case when title is not null then level end ignore nulls) over (partition by doc_id order by i) as lev,
    sum((title is not null or flush)::int) over (partition by doc_id order by i) as b from hd),
blk as (
  select doc_id, b, {trim("string_agg(line, chr(10) order by i)")} as text, coalesce(any_value(now), 'PR Overview') as title, coalesce(any_value(lev), 1) as level
  from isl where title is null and not flush group by doc_id, b),
bk as (select * from blk where text <> ''),
ps as (
  select doc_id, 0 as k, b, level, title, ch, generate_subscripts(ch, 1) as j, unnest(ch) as text from (
    select *, case when len({paragraphs_of('text')}) > 0 then {paragraphs_of('text')} else [text] end as ch from bk)),
allp as (
  select doc_id, 0 as k, b, j, title, text from ps
  union all select doc_id, 1, ord, 0, 'Diff Changes', {SUMMARY} from hunk
  union all select doc_id, 2, 0, generate_subscripts(s, 1), 'PR Review Signals', unnest(s)['text'] from sg),
up as (
  select *, {trim('text')} as tt from allp where {trim('text')} <> ''
  qualify row_number() over (partition by doc_id, lower({trim('text')}) order by k, b, j) = 1),
alls as (
  select doc_id, 0 as k, b, title, level from bk
  union all select distinct doc_id, 1, 0, 'Diff Changes', 2 from hunk
  union all select doc_id, 2, 0, 'PR Review Signals', 2 from sg),
us as (select * from alls qualify row_number() over (partition by doc_id, lower(title) order by k, b) = 1),
so as (select *, row_number() over (partition by doc_id order by k, b) as ord from us)"""
query("pr_sections", f"with {PRTEXT} select doc_id, ord, {seq('sec', 'ord')} as section_id, title, level from so")
query("pr_paragraphs", f"""
with {PRTEXT}, po as (select *, row_number() over (partition by doc_id order by k, b, j) as n from up)
select po.doc_id, po.n as ord, {seq('sec', 'so.ord')} as section_id, po.tt as text from po left join so on so.doc_id = po.doc_id and so.title = po.title""")

# ---- markup, sources -------------------------------------------------------------------------------------


def entities(x):
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def tag_rows(tag):
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return f"""
x as (select page_id, unnest(regexp_extract_all(html, {q(pattern)}, 1)) as raw, generate_subscripts(regexp_extract_all(html, {q(pattern)}, 1), 1) as i from pages),
y as (select page_id, i, {spaces(entities("regexp_replace(raw, '<[^>]+>', ' ', 'g')"))} as text from x)"""


CLEAN = "^[0-9.\\-)" + RE_WS[1:-1] + "]+"
query("html_contents", f"with {tag_rows('p')} select page_id, row_number() over (partition by page_id order by i) as ord, text from y where text <> ''")
query("html_headings", f"with {tag_rows('a')} select page_id, row_number() over (partition by page_id order by i) as ord, {trim(f'regexp_replace(text, {q(CLEAN)}, chr(32))')} as title from y where text <> ''")
query("html_escaped", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as digest from pages")
query("anchored_slices", f"""
with s as (select page_id, html[1:len(html) // 3] as a, substr(html, len(html) // 2 + 1) as b from pages)
select page_id, md5(array_to_string(list_filter([a, b], lambda v: {trim('v')} <> ''), chr(10))) as digest from s""")
EXTRACTED = trim("regexp_replace(" + nl("{0}") + ", '[ \t]+\n', chr(10), 'g')")
query("payload_paragraphs", f"""
with body as (select doc_id, unnest(case when lang = 'fr' then string_split(text, chr(10)) when lang = 'es' then [text] else [replace(text, chr(10), chr(10) || chr(10))] end) as t,
   generate_subscripts(case when lang = 'fr' then string_split(text, chr(10)) when lang = 'es' then [text] else [replace(text, chr(10), chr(10) || chr(10))] end, 1) as a, lang from documents),
u as (select doc_id, a, unnest({paragraphs_of(EXTRACTED.replace('{0}', 't'))}) as text, generate_subscripts({paragraphs_of(EXTRACTED.replace('{0}', 't'))}, 1) as b
  from body where lang <> 'es' or {trim('t')} <> '')
select doc_id, row_number() over (partition by doc_id order by a, b) as ord, text from u""")

CITE_HINT = r"\[\d+(?:\s*,\s*\d+)*\]"
YEAR_HINT = r"\([A-Z][A-Za-z-]+(?: et al\.)?,\s*\d{4}[a-z]?\)"
ENSEMBLE = f"""
base as (select doc_id, text, lang, source as src_name, replace(text, chr(10), chr(10) || chr(10)) as cut from documents),
raw as (
  select doc_id, 1 as o, 'local' as source, [cut] as texts, lang, src_name, text from base
  union all select doc_id, 2, 'sentences', string_split(text, '. '), lang, src_name, text from base
  union all select doc_id, 3, 'headings', [cut || ' [1, 2]'], lang, src_name, text from base),
a as (select doc_id, o, source, unnest(texts) as t, generate_subscripts(texts, 1) as i from raw),
b as (select doc_id, o, source, i, generate_subscripts({paragraphs_of(EXTRACTED.replace('{0}', 't'))}, 1) as j, unnest({paragraphs_of(EXTRACTED.replace('{0}', 't'))}) as t from a),
c0 as (select doc_id, o, source, i, j, {spaces('t')} as t from b),
pp as (select * from c0 where len(t) >= 3 qualify row_number() over (partition by doc_id, o, lower(t) order by i, j) = 1),
ps as (select doc_id, o, count(*) as n, sum(len(t))::bigint as chars, count(*) filter ({match('t', CITE_HINT, False)} or {match('t', YEAR_HINT, False)}) as cited from pp group by all),
hs as (
  select doc_id, count(distinct lower(title)) as n from (
    select doc_id, {trim(f"regexp_replace({spaces('x')}, {q(CLEAN)}, '')")} as title from (
      select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda v: '1. ' || v)) as x from base))
  where len(title) >= 2 group by all),
st as (
  select r.doc_id, r.o, r.source, coalesce(ps.n, 0) as n, coalesce(ps.chars, 0) as chars, coalesce(ps.cited, 0) as cited,
    case when r.o = 3 then coalesce(hs.n, 0) else 0 end as secs, case when r.o = 2 then 2 else 0 end as bibs,
    case when r.o = 1 and r.lang = 'en' then 2 when r.o = 3 then 1 else 0 end as warns
  from raw r left join ps on r.doc_id = ps.doc_id and r.o = ps.o left join hs on hs.doc_id = r.doc_id),
mean as (select *, case when n > 0 then cast(chars as double) / n else 0.0 end as m, case when n > 0 then cast(cited as double) / n else 0.0 end as dens from st),
scored as (
  select *, {cents("least(60.0::double, n * 1.6::double) + least(45.0::double, cast(chars as double) / 240) + (case when m >= 60 and m <= 1000 then 12.0::double when m >= 30 then 5.0::double else -8.0::double end) + least(18.0::double, secs * 3.0::double) + least(14.0::double, bibs * 0.8::double) + least(16.0::double, dens * 32::double) - warns * 1.2::double")} as score from mean)"""
query("source_scores", f"with {ENSEMBLE} select doc_id, source, n as n_paragraphs, chars as n_chars, cited as n_cited, secs as n_sections, bibs as n_bib, warns as n_warnings, score from scored")
query("source_ensemble", f"""
with {ENSEMBLE},
u as (select * from scored where o = 1 or n > 0),
pr as (select doc_id, source as p from u qualify row_number() over (partition by doc_id order by score desc, o) = 1),
sd as (select doc_id, source as s from u where secs > 0 qualify row_number() over (partition by doc_id order by secs desc, o) = 1),
bd as (select doc_id, source as b from u where bibs > 0 qualify row_number() over (partition by doc_id order by bibs desc, o) = 1)
select pr.doc_id, p as "primary", coalesce(s, p) as section_donor, coalesce(b, p) as bib_donor from pr left join sd using (doc_id) left join bd using (doc_id)""")
NUM_KEYS = duck_regex(r"\[(\d+(?:\s*,\s*\d+)*)\]")
YEAR_KEYS = duck_regex(r"\(([A-Z][A-Za-z-]+(?: et al\.)?,\s*\d{4}[a-z]?)\)")
query("pdf_citations", f"""
with t as (select doc_id, text || ' [3, 12] as in (Smith et al., 2020a) and ' || source || ' [7] (Lee, 1999)' as t from documents),
n as (
  select doc_id,
    list_transform(list_filter(list_transform(string_split(array_to_string(regexp_extract_all(t, {q(NUM_KEYS)}, 1), ','), ','), lambda v: {trim('v')}), lambda v: v <> ''), lambda v: 'num:' || v) as a,
    list_transform(regexp_extract_all(t, {q(YEAR_KEYS)}, 1), lambda v: 'ay:' || regexp_replace(v, {q(RE_WS + '+')}, '_', 'g')) as b from t),
k as (select doc_id, list_concat(a, b) as ks from n),
d as (select doc_id, {distinct_in_order('ks')} as ks from k)
select doc_id, generate_subscripts(ks, 1) as ord, unnest(ks) as key from d""")
query("page_layout", f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
w as (select doc_id, i, unnest(string_split(line, ' ')) as w, generate_subscripts(string_split(line, ' '), 1) as j from l),
v as (select *, {spaces('w')} as t from w where {spaces('w')} <> ''),
o as (select *, row_number() over (partition by doc_id, i order by j) as k, lag(t) over (partition by doc_id, i order by j) as prev from v),
s as (select doc_id, i, string_agg(case when k = 1 or regexp_matches(prev, '[(\\[{{/"''\\-]$') or regexp_matches(t, '^[)\\]}}:;,.!?]') then t else ' ' || t end, '' order by k) as txt,
   max(-((j - 1) % 2)) as top from o group by all),
y as (select *, 800.0 - (i % 40) * 14 + top as y, lag(800.0 - (i % 40) * 14 + top) over (partition by doc_id, i // 40 order by i) as py from s)
select doc_id, i // 40 + 1 as page, md5({trim("string_agg((case when py - y > 12.5 then chr(10) else '' end) || txt, chr(10) order by i)")}) as digest from y group by doc_id, i // 40""")

# ---- ingest, archives -----------------------------------------------------------------------------------

REQ = """
r as (
  select doc_id, text, source, lang,
    case when source = 'src1' then 'BOOK' when source in ('src2', 'src3') then 'PR' when source in ('src4', 'src5') then 'SHEET' else 'DOC' end as kind,
    case when lang = 'fr' then 'diff' when lang = 'es' then 'pdf' when source = 'src6' then 'markdown' end as fmt
  from documents),
v as (
  select *, case when kind = 'BOOK' then 'artifact_type must be PAPER|PR|DOC|SHEET'
    when len({t}) = 0 then 'content must be a non-empty string'
    when len({t}) < 40 then 'content is too short (min 40 chars required)'
    when len({t}) > 200000 then 'content is too long (max 200000 chars)'
    when lang = 'de' then 'title is too long (max 120 chars)'
    when fmt = 'pdf' then 'content_format must be plain|markdown|diff|json'
    when (fmt = 'diff' and kind <> 'PR') or (fmt = 'markdown' and kind not in ('PR', 'DOC')) then 'content_format ' || fmt || ' is not allowed for ' || kind
    when source = 'src8' then 'source_ref is too long (max 240 chars)'
    when source in ('src9', 'src11') then 'retentionPolicy.mode must be NO_SAVE or SAVE'
    when source = 'src10' then 'retentionPolicy.ttlHours must be number'
    else '' end as error from r)""".replace("{t}", trim("text"))
query("artifact_validation", f"with {REQ} select doc_id, error from v")
query("artifact_objects", f"""
with {REQ}
select doc_id, case kind when 'PR' then 'PR_TEXT' when 'DOC' then 'DOC_TEXT' else 'SHEET_TEXT' end as input_type,
  case fmt when 'markdown' then 'text/markdown; charset=utf-8' when 'diff' then 'text/x-diff; charset=utf-8' else 'text/plain; charset=utf-8' end as content_type,
  source || case fmt when 'markdown' then '.md' when 'diff' then '.diff' else '.txt' end as file_name from v where error = ''""")
query("upload_metadata", """
select event_id, case event_type when 'click' then 'metadata is not valid JSON' when 'view' then 'metadata must be a JSON object'
  when 'error' then case when value > 10 then '' else 'metadata.artifactType must be PAPER|PR|DOC|SHEET' end
  when 'purchase' then case when value > 20 then 'metadata.retentionPolicy.ttlHours must be number' else 'metadata.language must be string' end
  else '' end as error from events""")
MEMBERS = """
m as (
  select l_orderkey as archive_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as ordinal,
    case when l_discount >= 0.1 then '../x.' || e when l_tax >= 0.08 then 'run.exe' else '/dir' || chr(92) || 'f' || l_linenumber || '.' || e end as path,
    cast(trunc(l_extendedprice * 300) as bigint) as size, l_quantity >= 50 as link, l_quantity = 1 as is_dir
  from (select *, case l_returnflag when 'A' then 'tex' when 'N' then 'bib' else 'PNG' end as e from lineitem)),
r as (
  select *, sum((not is_dir)::int) over w as n, sum(case when is_dir then 0 else size end) over w as total
  from m window w as (partition by archive_id order by ordinal)),
k as (
  select *, case when link then 'symlink' when path like '../%' then 'unsafe_path' when is_dir then null
    when path = 'run.exe' then 'disallowed_extension' when n > 2000 then 'too_many_files'
    when size > 20971520 then 'file_too_large' when total > 209715200 then 'archive_too_large' end as rule from r)"""
query("archive_screening", f"""
with {MEMBERS},
f as (select archive_id, rule, path from k where rule is not null qualify row_number() over (partition by archive_id order by ordinal) = 1),
a as (select archive_id, count(*) as members from m group by all)
select a.archive_id, members, coalesce(f.rule, '') as rule, coalesce(f.path, '') as path, f.rule is null as accepted from a left join f using (archive_id)""")
query("main_files", "select doc_id as archive_id, case when lang = 'en' then 'paper/main.tex' else 'main.tex' end as main_path from documents")
query("latex_includes", f"""
with s as (
  select doc_id, chr(92) || 'section{{' || source || '}}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'middle ' || chr(10) || ' end % note' || chr(10) as t from documents),
u as (select doc_id, regexp_replace({nl('t')}, {q(CUT)}, '\\1', 'g') as t from s)
select doc_id as archive_id, md5(t) as digest, len(t) as chars from u""")
query("include_warnings", "select doc_id as archive_id, 'Included file not found: ' || lang as warning from documents")
query("bib_keys", "select doc_id as archive_id, 1 as ord, lang as key from documents union all select doc_id, 2, 'k2' from documents")

# ---- records and views ------------------------------------------------------------------------------------

SUBS = """
s as (
  select 's' || o_custkey as session_id, 'sub' || o_orderkey as submission_id, o_orderkey, o_orderstatus, o_orderpriority,
    case when o_orderstatus = 'P' then 'no date' else strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' end as created_at,
    case when o_orderstatus = 'P' then timestamp '1970-01-01' else o_orderdate end as moment from orders),
ls as (select * from s qualify row_number() over (partition by session_id order by moment desc, o_orderkey) = 1)"""
query("latest_per_session", f"with {SUBS} select session_id, submission_id, created_at from ls")
query("session_view", f"""
with {SUBS},
la as (
  select 's' || o_custkey as session_id, 'an' || o_orderkey as analysis_id, o_orderstatus as st from orders
  qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1),
c as (select 's' || c_custkey as session_id, c_acctbal > 0 as save, c_mktsegment as seg, c_nationkey from customer),
k as (select *, case o_orderpriority when '1-URGENT' then 'PR' when '2-HIGH' then 'DOC' else 'PAPER' end as kind from ls)
select c.session_id, coalesce(analysis_id, '') as analysis_id, coalesce(submission_id, '') as submission_id, coalesce('upl_' || submission_id, '') as upload_id,
  coalesce('my_file_' || o_orderpriority || '.' || lower(o_orderstatus), '') as filename, coalesce('my_file_' || o_orderpriority, '') as title,
  coalesce(case when kind = 'PAPER' then case when o_orderstatus = 'F' then 'pdf' else 'zip' end when kind is not null then 'artifact' end, '') as file_type,
  coalesce(kind, '') as artifact_type,
  case when st is null then 'active' when st = 'F' then 'completed' when st = 'P' then 'error' else 'analyzing' end as status,
  save as save_enabled, case seg when 'MACHINERY' then 2 when 'AUTOMOBILE' then 1 else case when save then 30 else 1 end end as retention_days,
  case when c_nationkey < 5 then 'en' else 'ja' end as language
from c left join la using (session_id) left join k using (session_id)""")
query("recent_sessions", "with r as (select o_orderkey as session_id, row_number() over (order by o_orderdate desc, o_orderkey desc) as rank from orders qualify rank <= 10) select rank, session_id, rank <= 3 as shown from r")
query("merge_updates", """
select user_id as analysis_id, coalesce('x' || arg_max(event_id, (ts, event_id)) filter (event_type = 'signup'), '') as extract_pointer,
  coalesce(cast(arg_max(event_id, (ts, event_id)) filter (event_type = 'purchase') as varchar), '') as report_pointer from events group by all""")
STATUS = "case event_type when 'signup' then 'QUEUED' when 'view' then 'EXTRACTING' when 'click' then 'ANALYZING' when 'purchase' then 'READY' else 'FAILED' end"
LATEST = f"""
u as (select user_id, event_type, value, props, row_number() over (partition by user_id order by ts desc, event_id desc) as rk, {STATUS} as status from events),
st as (select user_id, case event_type when 'view' then 'extract' else 'evidence' end as step from events where event_type in ('view', 'click')
  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"""
query("latest_status", f"""
with {LATEST}
select user_id as analysis_id, status, value as progress, coalesce(step, '') as step, case event_type when 'error' then 'failed with ' || props else '' end as error,
  status in ('READY', 'FAILED') as terminal from u left join st using (user_id) where rk = 1""")
query("progress_view", f"""
select event_id as seq, least(100.0, greatest(0.0, case when value <= 1 then value * 100 else value end)) as progress,
  case event_type when 'error' then 'failed with ' || props when 'purchase' then {q(fx.PROGRESS_BY_STATUS['READY'])} when 'view' then {q(fx.PROGRESS_BY_STEP['extract'])}
    when 'click' then {q(fx.PROGRESS_BY_STEP['evidence'])} else {q(fx.PROGRESS_QUEUED)} end as message from events""")
query("latest_turns", "select conv_id, role as turn_id, turn as seq, md5(text) as digest from conversations qualify row_number() over (partition by conv_id, role order by turn desc) = 1")
TRACE = f"""
tr as (
  select user_id, event_id, coalesce({arr(fx.AGENT_ROLES)}[cast(floor(value) as bigint) % 11 + 1], 'OTHER') as role,
    case event_type when 'error' then 'WARN' when 'signup' then 'SKIPPED' else 'DONE' end as status, ts, value from events),
steps as (select unnest({arr(fx.AGENT_ROLES)}) as role, generate_subscripts({arr(fx.AGENT_ROLES)}, 1) as step)"""
query("trace_progress", f"""
with {TRACE},
runs as (select distinct user_id || '|' || strftime(ts, '%Y-%m-%d') as run from tr),
seen as (select distinct user_id || '|' || strftime(ts, '%Y-%m-%d') as run, role from tr),
x as (select runs.run, steps.step, steps.role, seen.role is not null as done from runs cross join steps left join seen on seen.run = runs.run and seen.role = steps.role)
select run, count(*) filter (done) as done, cast(floor(count(*) filter (done) * 100 / 8.0 + 0.5) as bigint) as percent, coalesce(arg_min(role, step) filter (not done), '') as first_missing from x group by run""")
query("trace_durations", f"with {TRACE} select event_id as seq, greatest(1, epoch_us(ts + to_microseconds(cast(round(value * 1000000) as bigint))) // 1000 - epoch_us(ts) // 1000) as duration_ms, status from tr")
query("step_states", f"""
with {TRACE}, {LATEST},
last as (select user_id, role, status from tr qualify row_number() over (partition by user_id, role order by event_id desc) = 1),
x as (
  select u.user_id, u.status as run, steps.step, steps.role, last.status as st from u cross join steps left join last on last.user_id = u.user_id and last.role = steps.role where rk = 1),
y as (select *, min(case when st is null then step end) over (partition by user_id) as fm from x)
select user_id as analysis_id, step, role, case when st in ('DONE', 'SKIPPED') then 'done' when st = 'WARN' then 'warn' when run in ('READY', 'FAILED') then 'pending' when step = fm then 'active' else 'pending' end as state from y""")
query("lease_status", f"""
select event_id as seq, case when {STATUS} in ('READY', 'FAILED') then 'finished' when value > 5 and date_trunc('second', ts) > timestamp '2024-01-10' then 'locked' else 'free' end as lease from events""")


def limiter(key: str, limit: int, window: int) -> str:
    return f"""
e as (select {key} as key, event_id, epoch_us(ts) // 1000 as ms from events),
walk as (
  select key, min(ms) as start from e group by key
  union all
  select key, (select min(ms) from e where e.key = walk.key and e.ms >= walk.start + {window}) as start from walk where start is not null),
starts as (select key, start from walk where start is not null),
placed as (select e.key, e.event_id, e.ms, s.start from e asof join starts s on e.key = s.key and e.ms >= s.start),
ranked as (select *, row_number() over (partition by key, start order by ms, event_id) <= {limit} as allowed from placed)"""


query("rate_limit", f"with recursive {limiter('user_id', 2, 43200000)} select key, event_id as request_id, allowed, case when allowed then 0 else 43200000 - (ms - start) end as retry_after_ms, start as window_start from ranked")

query("rate_limit_analyze", f"with recursive {limiter("'all'", 60, 60000)} select event_id as request_id, allowed, start as window_start from ranked")

# ---- answers, patches, reports -------------------------------------------------------------------------------

ANSWERS = f"""
a as (select conv_id, turn, text, {trim('text')} as t, len({trim('text')}) >= 80 as pass from conversations where role = 'user'),
v as (
  select *, case when pass then {M['oral_pass']} else {M['oral_revise']} end as reason, case when pass then {M['oral_draft_pass']} else {M['oral_draft_revise']} end as draft from a)"""
query("answer_evaluation", f"with {ANSWERS} select conv_id, turn, pass, not pass as follow_up, reason, draft, case when pass then '' else {M['oral_todo']} end as todo_title from v where t <> ''")
query("turn_expansion", f"""
with {ANSWERS}, k as (select v.* from v join customer on c_custkey = conv_id where c_acctbal > 0 and t <> '')
select conv_id, turn, 1 as seq, 'USER' as role, 'ANSWER' as type, text as content from k
union all select conv_id, turn, 2, 'AI', 'QUESTION', {M['oral_fallback']} from k
union all select conv_id, turn, 3, 'AI', 'EVAL', case when pass then 'PASS: ' else 'REVISE: ' end || reason from k
union all select conv_id, turn, 4, 'AI', 'DRAFT', draft from k""")


def rolling(x):
    """Base-36 rolling hash, from the code points of the text."""
    digits = "'0123456789abcdefghijklmnopqrstuvwxyz'"
    h = f"list_reduce(list_concat([0::ubigint], list_transform(string_split({x}, ''), lambda ch: unicode(ch)::ubigint)), lambda a, b: (a * 31 + b) % 4294967296)"
    powers = [36**i for i in range(6, -1, -1)]
    chars = " || ".join(f"{digits}[cast(({h}) // {p} % 36 as bigint) + 1]" for p in powers)
    return f"coalesce(nullif(ltrim({chars}, '0'), ''), '0')"


query("oral_todos", f"""
with d as (select conv_id * 1000 + turn as seq, {trim("lower(text)")} as s, role = 'assistant' as auto from conversations),
h as (select *, {rolling('s')} as h from d where s <> '')
select 'todo_oral_' || h as todo_id, arg_min(s, seq) as title, case when bool_or(auto) then 'accepted' else 'pending' end as status, max(seq) as last_seq from h group by h""")
query("text_hash", f"select conv_id, turn, {rolling('text')} as hash, sha256(coalesce(nullif({trim('text')}, ''), 'anonymous')) as sha from conversations")
query("patch_text", f"""
with t as (select conv_id, turn, {collapse('text')} as title, role = 'assistant' and len(text) > 400 as ok from conversations),
b as (select conv_id, count(*) filter (ok and title <> '') as n, string_agg('+- [ ] ' || title, chr(10) order by turn) filter (ok and title <> '') as lines from t group by all),
f as (select conv_id, 'docs/analysis_' || conv_id || '.md' as p, greatest(n, 1) as n, coalesce(lines, '+<!-- no accepted todos -->') as lines from b),
d as (select conv_id, 'diff --git a/' || p || ' b/' || p || chr(10) || 'index 0000000..1111111 100644' || chr(10) || '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) || '@@ -0,0 +1,' || n || ' @@' || chr(10) || lines || chr(10) as diff_text from f)
select cast(conv_id as varchar) as analysis_id, diff_text, 1 as files, 1 as hunks from d""")
query("todo_overlay", """
with c as (select conv_id, 't' || text as id, turn, role from conversations),
u as (select distinct conv_id, id from c),
o as (select conv_id, id from c where role = 'user' group by all having count(*) > 1)
select u.conv_id as doc_id, count(o.id) as accepted, count(*) - count(o.id) as pending from u left join o on o.conv_id = u.conv_id and o.id = u.id group by u.conv_id""")
query("todo_rows", """
with c as (select conv_id, 't' || text as id, turn, case when role = 'user' then 0 else 1 end as src from conversations where role is not null),
o as (select conv_id, id from c where src = 0 group by all having count(*) > 1)
select c.conv_id as doc_id, md5(c.id) as todo, turn as ord, src, case when o.id is null then 'pending' else 'accepted' end as status
from c left join o on o.conv_id = c.conv_id and o.id = c.id
qualify row_number() over (partition by c.conv_id, c.id order by src, turn) = 1""")
ROW = "'    <tr><th>{0}</th><td>' || {1} || '</td></tr>'"
query("report_html", "with e as (select o_orderkey as id, '&lt;s&amp;' || o_custkey || '&gt;' as s, '&quot;' || o_orderpriority || '&#39;' as b, o_orderstatus as st, case when o_orderstatus = 'F' then 'finalize' else '-' end as step from orders) "
  "select id as analysis_id, md5(array_to_string(['<!doctype html>', '<html lang=\"en\">', '<head>', '  <meta charset=\"utf-8\" />', "
  "'  <meta name=\"viewport\" content=\"width=device-width, initial-scale=1\" />', '  <title>Analysis Report - ' || id || '</title>', '</head>', '<body>', "
  "'  <h1>Analysis Report</h1>', '  <table border=\"1\" cellpadding=\"8\" cellspacing=\"0\">', "
  + ", ".join(ROW.format(a, b) for a, b in (("analysisId", "id"), ("sessionId", "s"), ("submissionId", "b"), ("status", "st"), ("progress", "'100'"), ("step", "step")))
  + ", '  </table>', '</body>', '</html>', ''], chr(10))) as digest from e")
query("pr_composed", f"""
with p as (select doc_id, source, lang, {trim('text')} as ch, {trim('source || chr(10) || text')} as df from documents)
select doc_id, array_to_string(list_filter(['# Summary', source, '## Background', '## Changes', ch, '## Test Plan', lang, '## Risks', '## Rollback', 'revert', '## Diff', df], lambda x: x <> ''), chr(10)) as body from p""")

# ---- the whole job ------------------------------------------------------------------------------------------

query("artifact_rejects", """
select doc_id, case lang when 'fr' then 'DOC' when 'de' then 'PR' when 'es' then 'PAPER' else 'SHEET' end as artifact_type,
  case lang when 'es' then 'no extract row for the paper' else 'inputType does not match artifactType' end as reason from documents where source = 'src13'""")
DIGEST = "md5(string_agg({0} || '|' || text, chr(10) order by ord)) as digest"
query("routed_artifacts", f"""
with lang as (select doc_id, lang from documents where source <> 'src13'),
s as (select doc_id, count(*) as n, {DIGEST.format(seq('par', 'ord'))} from (with {SHEET} select doc_id, ord, text from p) group by all),
d as (
  select doc_id, count(*) as n, {DIGEST.format(seq('par', 'ord'))} from (
    with {DOC} select doc_id, ord, text from numbered union all select doc_id, n_paras + generate_subscripts(s, 1) as ord, unnest(s) as text from sigp) group by all),
r as (
  select doc_id, count(*) as n, {DIGEST.format(seq('par', 'ord'))} from (
    with {PRTEXT} select doc_id, row_number() over (partition by doc_id order by k, b, j) as ord, tt as text from up) group by all),
a as (select doc_id, count(*) as n, {DIGEST.format(seq('p', 'ord'))} from (with {PAPER} select doc_id, ord, text from paras) group by all)
select doc_id, 'DOC' as artifact_type, n as paragraphs, digest from lang join d using (doc_id) where lang = 'fr'
union all select doc_id, 'PR', n, digest from lang join r using (doc_id) where lang = 'de'
union all select doc_id, 'PAPER', n, digest from lang join a using (doc_id) where lang = 'es'
union all select doc_id, 'SHEET', n, digest from lang join s using (doc_id) where lang not in ('fr', 'de', 'es')""")
KIND_TITLE = " ".join(f"when '{k}' then {q(v[2])}" for k, v in K.items() if k != "UNKNOWN_FIGURE_NUMBER")
RISKS_REFINED = REFINED + RISKS[len(CLAIMS):]
WITH_FINDINGS = (
    "firsts as (",
    f"""allf as (
  select * from allr
  union all select doc_id, 2, n, case severity when 'error' then 'HIGH' else 'MEDIUM' end, case kind {KIND_TITLE} end, message, '', 0, replace(paragraph_ids, ',', '+') from fo),
firsts as (""",
)
PAPER_AUDIT = (RISKS_REFINED + REPORT).replace(
    SHEET, FINDINGS + ",\np as (select doc_id, text, ord, 0 as n_body from paras)"
).replace(*WITH_FINDINGS).replace("from allr qualify dup = 1", "from allf qualify dup = 1")
query("analysis_summary", f"""
with {PAPER_AUDIT},
gate as (select doc_id from p group by doc_id having count(*) >= 8 and sum(len(text)) >= 2500),
t3 as (select doc_id, string_agg(title, '|' order by rank) as top3 from top where rank <= 3 group by all),
cl as (
  select c.doc_id, string_agg('claim_' || c.n || '|' || c.text || '|' || coalesce(severity, 'LOW') || '|' || coalesce(reason, {M['no_evidence_risk']}) || '|' ||
    case when ev.code is null then {seq('p', 'c.para')} else array_to_string(list_transform(para_ids, lambda x: replace(x, 'par_', 'p_')), '+') end, chr(10) order by c.n) as claims
  from c left join ev on c.doc_id = ev.doc_id and c.n = ev.n group by c.doc_id),
er as (select doc_id, count(*) filter (severity = 'error') as e from fo group by all)
select gate.doc_id, coalesce(top3, '') as top3, claims, coalesce(e, 0) as error_count from gate join cl using (doc_id) left join t3 using (doc_id) left join er using (doc_id)""")

# SHEET texts have no figures or citations: all references to them are findings.
SHEET_FINDINGS = f""",
paras as (select doc_id, ord, {seq('par', 'ord')} as para_id, text from p),
{LREF},
{NREF},
found as (
  select r.doc_id, 2 as k, min(r.ord) as a, r.label as b, 'UNKNOWN_FIGURE_REFERENCE' as kind, 'error' as severity, {message('UNKNOWN_FIGURE_REFERENCE', 'r.label')} as message, string_agg(para_id, ',' order by r.ord) as paragraph_ids
  from lref r group by r.doc_id, r.label
  union all
  select r.doc_id, 3, min(r.ord), r.num, 'UNKNOWN_FIGURE_REFERENCE', 'warning', {message('UNKNOWN_FIGURE_NUMBER', 'r.num')}, string_agg(para_id, ',' order by r.ord) from nref r group by r.doc_id, r.num),
fo as (select *, row_number() over (partition by doc_id order by k, a, b) as n from found)"""
JOB = (
    (RISKS_REFINED + REPORT).replace(LOGIC, SHEET_FINDINGS + LOGIC).replace(*WITH_FINDINGS).replace("from allr qualify dup = 1", "from allf qualify dup = 1")
    + f""",
gate as (select doc_id from p group by doc_id having count(*) >= 6 and sum(len(text)) >= 700),
pq as (
  select c.doc_id, c.n, coalesce((select string_agg(t, ' ' order by i) from (
    select t, min(i) as i from (select unnest(ks) as t, generate_subscripts(ks, 1) as i) group by t)), '{' '.join(fx.DEFAULT_KEYWORDS)}') as query
  from (select doc_id, n, {tokens('text', fx.KEYWORD_STOP_WORDS)} as ks from c) c),
jc as (select doc_id, count(*) as nc, string_agg('claim_' || n || '|' || text || '|' || {seq('par', 'para')}, chr(10) order by n) as claims from c group by all),
je as (
  select doc_id, count(*) as ne, count(*) filter (severity = 'HIGH') as eh, string_agg('claim_' || n || '|' || severity || '|' || reason || '|' || array_to_string(para_ids, '+'), chr(10) order by n) as evidence,
    count(*) filter (len(para_ids) = 0) as none, count(*) filter (len(para_ids) > 0) as weak, string_agg('claim_' || n || ':' || severity, '|' order by n) filter (rn <= 3) as ehl
  from (select *, row_number() over (partition by doc_id order by n) as rn from ev) group by all),
jl as (
  select doc_id, count(*) as nl, count(*) filter (severity = 'HIGH') as lh, count(*) filter (severity in ('HIGH', 'MEDIUM')) as spec, count(*) filter (severity = 'LOW') as low,
    string_agg('claim_' || n || '|' || severity || '|' || reason, chr(10) order by n) as logic, string_agg('claim_' || n || ':' || severity, '|' order by n) filter (rn <= 3) as lhl
  from (select *, row_number() over (partition by doc_id order by n) as rn from lr) group by all),
jq as (select doc_id, string_agg('claim_' || n || '|' || query, chr(10) order by n) as queries, string_agg(query, '|' order by n) filter (n <= 3) as qhl from pq group by all),
jt as (select doc_id, count(*) as nt, string_agg(severity || '|' || title || '|' || reason || '|' || cid || '|' || pids, chr(10) order by rank) as risks from top group by all),
jf as (select doc_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warns from fo group by all),
job as (
  select gate.doc_id, nc, claims, coalesce(ne, 0) as ne, coalesce(eh, 0) as eh, coalesce(evidence, '') as evidence, coalesce(ehl, '') as ehl, coalesce(nl, 0) as nl, coalesce(lh, 0) as lh,
    coalesce(logic, '') as logic, coalesce(lhl, '') as lhl, queries, qhl, coalesce(nt, 0) as nt, coalesce(risks, '') as risks, coalesce(none, 0) as none, coalesce(weak, 0) + coalesce(low, 0) as weak,
    coalesce(spec, 0) as spec, coalesce(errors, 0) as errors, coalesce(warns, 0) as warns, iterations, replacements, weak_claims, warnings
  from gate join jc using (doc_id) join report using (doc_id) join jq using (doc_id) left join je using (doc_id) left join jl using (doc_id) left join jt using (doc_id) left join jf using (doc_id))"""
)
query("analysis_result", f"""
with {JOB}
select doc_id, claims, evidence as evidence_risks, logic as logic_risks, queries as prior_art_queries, risks as top_risks, none as no_evidence_claims, weak as weak_evidence_claims,
  spec as specificity_lack, errors as error_count, warns as warning_count, warnings from job""")
STEP = "select doc_id, {0} as seq, lower('{1}') as agent_id, '{1}' as role, {2} as status, {3} as summary, {4} as highlights from job"
WARN = "case when {0} then 'WARN' else 'DONE' end"
TRACE_STEPS = " union all ".join(
    STEP.format(n, *x)
    for n, x in enumerate(
        [
            ("PLANNER", "'DONE'", "'artifact=SHEET, thresholds=6/700'", "''"),
            ("EXTRACTOR", WARN.format("n_numeric = 0"), "'paragraphs=' || np || ', sections=2'", "'figures=0|citations=0/0'"),
            ("CLAIM_MINER", WARN.format("warnings <> ''"), "'claims=' || nc || ', llmWarnings=' || (warnings <> '')::int || ', refineIter=' || iterations",
             "case when warnings <> '' then warnings else 'refinedReplacements=' || replacements || '|weakAfterRefine=' || weak_claims end"),
            ("PREFLIGHT_GUARDIAN", WARN.format("errors > 0"), "'errors=' || errors || ', warnings=' || warns", "''"),
            ("EVIDENCE_AUDITOR", WARN.format("eh > 0"), "'risks=' || ne || ', high=' || eh", "ehl"),
            ("LOGIC_SENTINEL", WARN.format("lh > 0"), "'logicRisks=' || nl || ', high=' || lh", "lhl"),
            ("PRIOR_ART_COACH", "'DONE'", "'queries=' || nc", "qhl"),
            ("SYNTHESIZER", WARN.format("warnings <> ''"), "'topRisks=' || nt || ', warnings=' || (warnings <> '')::int",
             "'noEvidence=' || none || '|weakEvidence=' || weak || '|specificityLack=' || spec"),
        ],
        1,
    )
)
query("job_trace", f"""
with {JOB.replace("job as (", "base as (")},
job as (select base.*, n_numeric, np from base join counted using (doc_id) join (select doc_id, count(*) as np from p group by all) using (doc_id))
select *, true as timed from ({TRACE_STEPS})""")

query("vague_counts", f"with {RISKS} select 'no_condition' as type, (select count(*) from lr) + (select count(*) from top where doc_id not in (select doc_id from lr)) as n")
query("strength_from_risks", f"with {RISKS} select doc_id, cid as claim_id, title as text, case when n_paras > 0 then 'moderate' else 'none' end as strength from top")
query("focus_claims", f"""
with {CLAIMS}
select d.doc_id, coalesce(c.text, '') as focus_text from documents d
left join c on c.doc_id = d.doc_id and c.n = case lang when 'en' then 2 when 'de' then 99 else 1 end""")
ORAL_HEAD = "\n".join(
    ["タスク: 口頭試問で使う質問を1つ生成し、期待回答の要点を作る。", *fx.COMMON_PROMPT_RULES, "出力スキーマ:",
     '{ "question": "...", "expectedAnswer": "...", "claimId": "...", "paragraphIds": ["..."] }',
     "question と expectedAnswer は日本語で書く。", "対象claim ID: claim_1", "対象claim: "]
)
query("oral_prompts", f"""
with {CLAIMS},
x as (select doc_id, string_agg('[claim_' || n || '] ' || text, chr(10) order by n) as ctx, min(text) filter (n = 1) as f from c group by all)
select doc_id, md5({q(ORAL_HEAD)} || f || chr(10) || '入力文書:' || chr(10) || ctx) as digest from x""")
EVIDENCE_HEAD = "\n".join(
    ["タスク: 各claimに対応する根拠段落・図・引用を対応づける。", *fx.COMMON_PROMPT_RULES, "出力スキーマ:",
     '{ "evidence": [{ "claimId": "...", "paragraphIds": ["..."], "figureIds": ["..."], "citationKeys": ["..."], "reason": "..." }] }', "Claims:", ""]
)
query("evidence_prompts", f"""
with {CLAIMS}, {segments(120, 24)[len(SHEET) + 1:]},
body as (select doc_id, seg, string_agg('[' || {seq('par', 'ord')} || '] ' || ptext, chr(10) order by o) as body from placed group by all),
cs as (select doc_id, string_agg('- claim_' || n || ': ' || text, chr(10) order by n) as cs from c group by all)
select doc_id, seg + 1 as segment, md5({q(EVIDENCE_HEAD)} || cs || chr(10) || '入力文書:' || chr(10) || body) as digest from body join cs using (doc_id)""")
query("figure_mentions_joined", f"""
with {PAPER}
select f.doc_id, f.figure_id, coalesce(string_agg(r.para_id, ',' order by r.ord), '') as mentioned_in
from fig f left join (select distinct doc_id, ord, para_id, lower(label) as k from lref) r on r.doc_id = f.doc_id and r.k = lower(f.label)
group by all""")

query("claims_with_model", f"""
with {CLAIMS},
raw as (
  select doc_id, ord, {claim_text('text')} as text from p
  where doc_id in (select doc_id from p group by doc_id having count(*) >= 4)),
sc as (
  select *, {claim_key('text')} as key, {cents(f"(case when {match_any('text', fx.CLAIM_PATTERNS)} then 2.0 else 0.0 end) + (case when regexp_matches(text, '[0-9]') then 1.0 else 0.0 end) + (case when {match('text', fx.CANDIDATE_CUE)} then 1.0 else 0.0 end) + 0.5::double + least(2.0::double, cast(len(text) as double) / 120)")} as score
  from raw where len(text) >= 12),
best as (select doc_id, key, min(ord) as place, arg_max((text, ord, score), (score, -ord)) as b from sc group by all),
ranked as (
  select doc_id, row_number() over (partition by doc_id order by b[3] desc, place) as n, b[1] as text, b[2] as para from best),
u as (select doc_id, n, text, para, 0 as src from ranked union all select doc_id, n, text, para, 1 from c),
ud as (select *, row_number() over (partition by doc_id, lower({collapse('lower(text)')}) order by src, n) as dup from u),
merged as (
  select doc_id, row_number() over (partition by doc_id order by src, n) as n, text, para from ud where src = 0 or dup = 1),
allc as (select doc_id, 0 as src, n, text, para from merged union all select doc_id, 1, n, text, para from c)
{QUALITY.replace("from c join p", "from allc c join p").replace("select c.doc_id, c.n,", "select c.doc_id, c.src, c.n,").replace("select doc_id, n, text, para,", "select doc_id, src, n, text, para,")},
pool as (
  select *, row_number() over (partition by doc_id order by src, n) as pord, len(issues) as n_issues from (
    select * from qs where key <> '' qualify row_number() over (partition by doc_id, key order by src, n) = 1)),
cur0 as (select doc_id, n as place, text, para, quality, len(issues) as n_issues, key from qs where src = 0)
{refine_round(1)}{refine_round(2)}
select doc_id, row_number() over (partition by doc_id order by place) as ord, text, quality from cur2""")

# ---- storage and streams ---------------------------------------------------------------------------------

query("stored_artifacts", "select doc_id, strlen(text) as bytes, md5(text) as digest, starts_with(text, '%PDF-') as is_pdf from documents")
query("pdf_headers", """
select doc_id, source = 'src3' or starts_with(text, '%PDF-') as is_pdf, md5(case source when 'src3' then '%PDF-1.4 ' || text else text end) as digest from documents""")
query("artifact_files", "select page_id, md5(html) as digest from pages")
query("stored_results", f"with {CLAIMS} select d.doc_id, count(n) as claims, md5(coalesce(string_agg(c.text, chr(10) order by n), '')) as digest from documents d left join c using (doc_id) group by d.doc_id")
query("new_records", """
select 'sub' || o_orderkey as submission_id, case o_orderpriority when '1-URGENT' then 'PR' when '2-HIGH' then 'DOC' else 'PAPER' end as artifact_type,
  case when o_orderkey % 3 = 0 then 'READY' else 'UPLOADED' end as status, o_custkey = 1 as of_first_session from orders""")
query("record_lookup", """
select 's' || o_custkey as session_id, 'sub' || o_orderkey as submission_id,
  case o_orderpriority when '1-URGENT' then 'PR' when '2-HIGH' then 'DOC' when '5-LOW' then '' else 'PAPER' end as artifact_type
from orders where 's' || o_custkey = (select min('s' || o_custkey) from orders)""")
query("repeated_writes", """
select 'text' as kind, cast(doc_id as varchar) as id, md5(text) as digest, case when doc_id % 2 = 0 then 2 else 1 end as rows from documents
union all select 'result', cast(doc_id as varchar), md5(text), case when doc_id % 2 = 0 then 2 else 1 end from documents
union all select 'record', 'sub' || o_orderkey, md5('s' || o_custkey), 2 from orders""")
query("snapshot_merge", f"""
with {LATEST},
m as (
  select user_id, coalesce('x' || arg_max(event_id, (ts, event_id)) filter (event_type = 'signup'), '') as extract_pointer,
    coalesce(cast(arg_max(event_id, (ts, event_id)) filter (event_type = 'purchase') as varchar), '') as report_pointer from events group by all),
e as (select user_id, arg_max(value, (ts, event_id)) as progress from events group by all)
select u.user_id as analysis_id, u.status, e.progress, coalesce(st.step, '') as step, case when u.event_type = 'error' then 'failed with ' || u.props else '' end as error, extract_pointer, report_pointer
from u left join st using (user_id) join m using (user_id) join e using (user_id) where rk = 1""")
query("latest_trace", f"""
with {TRACE},
d as (select *, ts::date as day, max(ts::date) over (partition by user_id) as last from tr)
select user_id as analysis_id, count(*) as entries, string_agg(event_id || ':' || role || ':' || status, '|' order by event_id) as trace from d where day = last group by all""")
query("sparse_sources", f"select doc_id, len({paragraphs_of('text')}) < 4 or len(string_split(text, ' ')) < 40 as sparse from documents")
query("tei_bibliography", f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select doc_id, i as ord, case when i % 2 = 1 then 'k' || (i - 1) else 'bib_' || i end as key, {spaces("regexp_replace(x, '[<>&]', ' ', 'g')")} as raw from l""")
query("model_answers", f"""
with {segments(120, 24)},
segs as (select doc_id, seg, string_agg('[' || {seq('par', 'ord')} || '] ' || ptext, chr(10) order by o) as body from placed group by all),
n as (select *, greatest(4, least(14, cast(ceil(36.0 / count(*) over (partition by doc_id)) as bigint) + 2)) as m from segs),
t as (select *, {q(PROMPT_HEAD)} || m || chr(10) || '注意: claim.text は元文の意味を維持し、冗長にしない。' || chr(10) || '入力文書:' || chr(10) || body as prompt from n)
select doc_id, seg + 1 as segment, len(prompt) || ' ' || (len(prompt) - len(replace(prompt, chr(10), ''))) as raw_json from t""")
query("model_once", f"""
with {segments(120, 24)},
segs as (select doc_id, seg, string_agg('[' || {seq('par', 'ord')} || '] ' || ptext, chr(10) order by o) as body from placed group by all),
n as (select *, greatest(4, least(14, cast(ceil(36.0 / count(*) over (partition by doc_id)) as bigint) + 2)) as m from segs),
t as (select *, {q(PROMPT_HEAD)} || m || chr(10) || '注意: claim.text は元文の意味を維持し、冗長にしない。' || chr(10) || '入力文書:' || chr(10) || body as prompt from n)
select doc_id, seg + 1 as segment, case when len(prompt) % 7 = 0 then '' else a end as first, case when len(prompt) % 7 = 0 then 'RuntimeError: no answer' else '' end as model_error,
  a as raw_json, case when len(prompt) % 7 = 0 then 2 else 1 end as calls
from (select *, len(prompt) || ' ' || (len(prompt) - len(replace(prompt, chr(10), ''))) as a from t)""")
query("model_paragraphs", f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
t as (select doc_id, i, {spaces('x')} as t from l),
u as (select * from t where len(t) >= 3 qualify row_number() over (partition by doc_id, lower(t) order by i) = 1)
select doc_id, row_number() over (partition by doc_id order by i) as ord, t as text from u""")
query("status_stream", f"""
with u as (select user_id, event_id, event_type, value, props, {STATUS} as status, row_number() over (partition by user_id order by event_id desc) as rk from events),
st as (select user_id, case event_type when 'view' then 'extract' else 'evidence' end as step from events where event_type in ('view', 'click')
  qualify row_number() over (partition by user_id order by event_id desc) = 1)
select user_id as analysis_id, status, value as progress, coalesce(step, '') as step, case event_type when 'error' then 'failed with ' || props else '' end as error
from u left join st using (user_id) where rk = 1""")
query("trace_stream", f"with {TRACE} select user_id as analysis_id, event_id as seq, role, status from tr")
query("progress_stream", f"""
with {TRACE},
runs as (select distinct user_id || '|' || strftime(ts, '%Y-%m-%d') as run from tr),
seen as (select distinct user_id || '|' || strftime(ts, '%Y-%m-%d') as run, role from tr),
x as (select runs.run, steps.step, steps.role, seen.role is not null as done from runs cross join steps left join seen on seen.run = runs.run and seen.role = steps.role)
select run, count(*) filter (done) as done, cast(floor(count(*) filter (done) * 100 / 8.0 + 0.5) as bigint) as percent, coalesce(arg_min(role, step) filter (not done), '') as first_missing from x group by run""")
query("limit_stream", """
with recursive e as (
  select cast(user_id as varchar) as key, event_id, epoch_us(ts) // 1000 as ms, cast(event_id % 3 as integer) as batch,
         row_number() over (partition by user_id order by event_id % 3, epoch_us(ts) // 1000, event_id) as rn from events),
walk as (
  select key, event_id, batch, ms, rn, ms as start, 1 as used, true as allowed from e where rn = 1
  union all
  select e.key, e.event_id, e.batch, e.ms, e.rn, case when e.ms - start >= 43200000 then e.ms else start end,
         case when e.ms - start >= 43200000 then 1 else least(2, used + 1) end, e.ms - start >= 43200000 or used < 2
  from walk join e on e.key = walk.key and e.rn = walk.rn + 1)
select key, event_id as request_id, batch, allowed, case when allowed then 0 else 43200000 - (ms - start) end as retry_after_ms, start as window_start from walk""")
query("ensemble_extract", f"""
with {ENSEMBLE},
u as (select * from scored where o = 1 or n > 0),
pr as (select doc_id, o as po from u qualify row_number() over (partition by doc_id order by score desc, o) = 1),
sd as (select doc_id, secs from u where secs > 0 qualify row_number() over (partition by doc_id order by secs desc, o) = 1),
bd as (select doc_id, o as bo from u where bibs > 0 qualify row_number() over (partition by doc_id order by bibs desc, o) = 1),
pt as (select pp.doc_id, count(*) as n, md5(string_agg(t, chr(10) order by i, j)) as digest from pp join pr on pp.doc_id = pr.doc_id and pp.o = pr.po group by all)
select base.doc_id, coalesce(pt.n, 0) as paragraphs, coalesce(secs, 0) as sections, case when bo is null then '' else lang || '|' || src_name end as bib, coalesce(digest, md5('')) as digest
from base left join pt using (doc_id) left join sd using (doc_id) left join bd using (doc_id)""")
