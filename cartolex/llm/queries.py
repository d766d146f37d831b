"""The queries of the operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm import bpe, codes, licenses, middle, minhash, mixing, pii, pivots, quality, secrets, substrings, topk, urls
from cartolex.llm.common import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(spans, keep=lambda s: F.lit(True)):
    return F.array_join(F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Words of a text in DuckDB, as a list.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op2_substrings"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i+12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
own as (select k, min(doc_id) as lo from win group by k),
hit as (select doc_id, i from win join own using (k) where doc_id > lo),
cov as (select distinct doc_id, i + unnest(range(0, 13)) as p from hit),
wd as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d),
kept as (select wd.doc_id, string_agg(x, ' ' order by wd.p) as t, count(*) as n from wd left join cov on wd.doc_id = cov.doc_id and wd.p = cov.p where cov.p is null group by wd.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


def _closure(ids: str, id_: str) -> str:
    """Labels by recursion over ``link(a, b)``, both directions."""
    return f"""reach(x, y) as (select a, b from link union select r.x, l.b from reach r join link l on r.y = l.a),
lab as (select x, least(x, min(y)) as c from reach group by x)"""


ORACLES["op1_pivots"] = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
{_closure("v", "vec_id")},
n as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept
from embeddings left join n on vec_id = a left join lab on vec_id = x"""

ORACLES["op3_minhash"] = f"""
with recursive d as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as g from d),
one as (select doc_id, len(g) as n, unnest(g) as x from s),
freq as (select x, count(*) as f from one group by x),
pre as (select doc_id, n, x from (select doc_id, n, one.x, row_number() over (partition by doc_id order by f, one.x) as r from one join freq on one.x = freq.x) where r <= n - ceil(0.8 * n) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b from pre a join pre b on a.x = b.x and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
half as materialized (select a, b from cand join s p on p.doc_id = a join s q on q.doc_id = b where 100 * len(list_intersect(p.g, q.g)) >= 80 * (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g)))),
link as (select a, b from half union all select b, a from half),
{_closure("s", "doc_id")}
select doc_id, len(g)::bigint as n_shingles, coalesce(c, doc_id) as component_id, doc_id = coalesce(c, doc_id) as kept from s left join lab on doc_id = x"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(spans_text("spans", lambda s: s["base"]), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source owns a repository for each language
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo"))
    found = secrets.scan_secrets(docs, repo="repo", owner="source")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text("spans", lambda s: s["base"]), 256).alias("base_sha256"), spans_text("spans").alias("spans"), n_live.alias("n_live"))


def _secret_sql(kind: str, nth: int, pattern: str, group: int, least: int, value_from: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, source, '{kind}' as kind, {nth} as nth, i, whole[i] as w, vals[i] as v,
        list_sum(list_transform(pieces[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0)::bigint as pos
      from (select doc_id, source, whole, vals, pieces, unnest(range(1, len(whole) + 1)) as i from (
        select doc_id, source, regexp_extract_all(t, '{quoted}', 0) as whole, regexp_extract_all(t, '{quoted}', {group}) as vals, string_split_regex(t, '{quoted}') as pieces from base))
      where length(vals[i]) >= {least}"""


ORACLES["op5_secrets"] = f"""
with base as (select doc_id, source, coalesce(text, '') as t from documents),
raw as ({" union all ".join([
    _secret_sql("assign", 0, secrets.BASE["assign"][0], 1, 6),
    _secret_sql("access", 1, secrets.BASE["access"][0], 1, 20),
    _secret_sql("hex", 2, secrets.BASE["hex"][0], 1, 24),
    _secret_sql("upperhex", 3, "([0-9A-Za-z]+)", 1, 32) + " and regexp_full_match(vals[i], '[0-9A-F]+')",
])}),
owned as (select sha256(v) as digest, count(distinct coalesce(source, '')) as n_owners from raw group by 1),
spans as (select r.*, (n_owners <= 1) as live from raw r join owned on sha256(v) = digest where nth < 3 or n_owners <= 1),
agg as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || pos || ':' || (pos + length(w)), ',' order by pos, nth) filter (nth < 3) as b,
  string_agg(kind || ':' || pos || ':' || (pos + length(w)), ',' order by pos, nth) as s, count(*) filter (live) as n_live from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(n_live, 0)::bigint as n_live
from documents d left join agg using (doc_id)"""

#: The rules of the contract: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_urls"] = f"""
with parts as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
rules(h, p, action) as (values {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)})
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc, h || p limit 1) as rule,
  coalesce((select action from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc, h || p limit 1), 'allow') as verdict
from parts"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix_sources(cut(sizes, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge_quality(docs, trusted_documents(spark, sf_dir)).select("doc_id", "lang", "perplexity", "threshold", "kept")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN
    back = bpe.encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, decode=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k_inner(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


ORACLES["op10_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10"""


@query
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    words = F.transform(base, lambda p: p["word"])
    labels = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), plain_from=90, spm_below=20)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op12_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, t, u, len(u) as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a+1:b], '') as mid, array_to_string(u[b+1:n], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) as output_sha256, sha256(t) as restored_sha256
from p"""


@query
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.lower(F.array_join(F.transform("code", lambda i: F.lpad(F.hex(i.cast("long")), 2, "0")), ""))
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and means as one common table after the other."""

    def assign(k: int) -> str:
        return f"""a{k} as materialized (select vec_id, p, x, min(struct_pack(d := d, e := e)) as b from (select vec_id, v.p, x, e,
  list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from part v join b{k} using (p)) group by vec_id, p, x)"""

    def move(k: int) -> str:
        return f"""m{k} as (select p, e, list(y order by j) as c from (select p, e, j, floor(sum(y)::double / count(*))::bigint as y
  from (select p, b.e as e, unnest(range(1, len(x) + 1)) as j, unnest(x) as y from a{k}) group by p, e, j) group by p, e),
b{k + 1} as materialized (select o.p, o.e, coalesce(m.c, o.c) as c from b{k} o left join m{k} m using (p, e))"""

    steps = ",\n".join(f"{assign(k)},\n{move(k)}" for k in range(rounds))
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select vec_id, p, w[len(w) // 4 * p + 1 : len(w) // 4 * (p + 1)] as x from v, range(0, 4) r(p)),
b0 as materialized (select p, e, x as c from (select p, x, row_number() over (partition by p order by vec_id) - 1 as e from part) where e < 256),
{steps},
{assign(rounds)},
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as h from b{rounds}),
row_ as (select vec_id, string_agg(lower(printf('%02x', b.e)), '' order by p) as code, sum(b.d)::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from row_ join v using (vec_id), book"""


ORACLES["op13_codes"] = _codes_sql()
