"""Text queries on documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import text
from causeway.plans.core import query
from causeway.sources import adapters

WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace({t}, '[\x00-\x08\x0B-\x1F]', ' ', 'g'), '\[[0-9, -]+\]', ' ', 'g')), '([a-z][a-z-]{{2,}})', 1)"
SHINGLES = "select distinct {k}, array_to_string(list_slice(w, i, i + 7), ' ') as s, n from (select {k}, w, unnest(range(1, greatest(len(w) - 6, 1))) as i, 0 as n from (select {k}, " + WORDS + " as w from {f}))"


@query("shingle_overlap", f"""with a as ({SHINGLES.format(k='doc_id', t='text', f='documents')}), b0 as ({SHINGLES.format(k='item_id', t='text', f='benchmark')}), b as (select item_id, s, count(*) over (partition by item_id) as of_ from b0)
select doc_id, item_id, count(*) as shared, round(count(*)::double / max(of_), 6) as rate from a join b on a.s = b.s group by 1, 2""")
def shingle_overlap(spark, sf_dir):
    o = text.shingle_overlap(adapters.table(spark, sf_dir, "documents"), adapters.table(spark, sf_dir, "benchmark"))
    return o.withColumn("rate", F.round("rate", 6))


@query("word_stats", f"select lang, count(*) as n_docs, sum(len({WORDS.format(t='text')})) as n_words from documents group by 1")
def word_stats(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents").select("lang", F.size(text.words(F.col("text"))).alias("w"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"))


@query("page_words", r"""select page_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '([A-Za-z0-9]+)', 1)) as n_words from pages""")
def page_words(spark, sf_dir):
    return adapters.table(spark, sf_dir, "pages").select("page_id", text.word_count(text.without_markup(F.col("html"))).cast("long").alias("n_words"))


@query("style_stats", r"""with s as (select doc_id, text, unnest(regexp_split_to_array(text, '[.!?]+[ \n\t\r]+')) as s from documents), l as (select doc_id, text, len(regexp_extract_all(s, '([A-Za-z0-9]+)', 1)) as n from s where regexp_matches(s, '[A-Za-z0-9]'))
select doc_id, count(*) as sentences, round(avg(n), 6) as mean_words, quantile_cont(n, 0.5)::double as median_words, round(avg((n > 35)::int), 6) as over35, round(avg((n > 45)::int), 6) as over45,
round(1000.0 * (length(max(text)) - length(replace(max(text), ',', ''))) / sum(n), 5) as commas_per_1000 from l group by doc_id""")
def style_stats(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents")
    s = d.select("doc_id", *[c.alias(n) for n, c in text.style(F.col("text")).items()]).where("sentences > 0")
    return s.select("doc_id", "sentences", F.round("mean_words", 6).alias("mean_words"), F.col("median_words").cast("double").alias("median_words"), F.round("over35", 6).alias("over35"), F.round("over45", 6).alias("over45"), F.round("commas_per_1000", 5).alias("commas_per_1000"))


@query("pattern_finder", r"select doc_id, len(regexp_extract_all(text, '(.{0,20}(?:, and ).{0,20})', 1)) as n from documents where len(regexp_extract_all(text, '(.{0,20}(?:, and ).{0,20})', 1)) > 0")
def pattern_finder(spark, sf_dir):
    return text.find_pattern(adapters.table(spark, sf_dir, "documents"), ", and ").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("dash_rewrite", r"select doc_id, md5(regexp_replace(regexp_replace(replace(text, ' the ', ' – '), '([0-9])[–—]([0-9])', '\1-\2', 'g'), ' *[–—] *', ', ', 'g')) as rewritten from documents")
def dash_rewrite(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.plain_dashes(F.replace("text", F.lit(" the "), F.lit(" – ")))).alias("rewritten"))


@query("key_xref", """with u as (select l_partkey as k, count(*) as uses from lineitem where l_quantity > 49 group by 1), d as (select distinct p_partkey as k from part where p_size > 25)
select coalesce(u.k, d.k) as k, case when d.k is null then 'undefined' else 'unused' end as kind, coalesce(u.uses, 0) as uses from u full join d on u.k = d.k where u.k is null or d.k is null""")
def key_xref(spark, sf_dir):
    used = adapters.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    defined = adapters.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    return text.cross_reference(used, defined, "k")


@query("tolerance_audit", """with c as (select n_nationkey as id, 5000.0::double as value from nation), f as (select c_nationkey as id, avg(c_acctbal) as found from customer group by 1)
select c.id, coalesce(abs(c.value - f.found) <= 600, false) as ok from c left join f on f.id = c.id""")
def tolerance_audit(spark, sf_dir):
    claimed = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(5000.0).alias("value"))
    found = adapters.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("value"))
    return text.within_tolerance(claimed, found, "id", 600.0).select("id", "ok")


@query("turn_lags", "select conv_id, count(*) as n, sum(case when role = p then 1 else 0 end) as repeats from (select conv_id, role, lag(role) over (partition by conv_id order by turn) as p from conversations) group by 1")
def turn_lags(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = adapters.table(spark, sf_dir, "conversations").select("conv_id", "role", F.lag("role").over(w).alias("p"))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("role") == F.col("p"), 1).otherwise(0)).alias("repeats"))
