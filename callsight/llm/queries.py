"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm import (
    decontamination,
    html_text,
    language_model,
    packing,
    periodic_runs,
    quality_rules,
    sharding,
    shingle_join,
    token_count,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from callsight.llm.common import table
from callsight.session import scratch_path

# The URL rules: host (with its subdomains), start of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Of 256 values of the first byte of a URL's MD5, those that put it on the list of the URL query.
LISTED_BYTES = 26


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def seen_elsewhere(url: Column) -> Column:
    """The same page as another list would write it: other scheme, `www.`, capitals, a slash at the
    end of the path, tracking parameters, a fragment."""
    host, path = url_filter.host(url), url_filter.path(url)
    capital = F.translate(F.regexp_replace(host, r"^www\.", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    return F.when(
        url.contains("://"),
        F.concat(F.lit("ftp://www."), capital, path, F.lit("/?utm_source=list&"), query, F.lit("&fbclid=7#seen")),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    chosen = pages.where(F.conv(F.substring(F.md5(url), 1, 2), 16, 10).cast("int") < LISTED_BYTES)
    listed = chosen.select(url_filter.canonical(seen_elsewhere(url)).alias("entry"))
    return url_filter.judge(pages, URL_RULES, listed)


OP2_SQL = f"""
with parts as (
  select page_id, url, coalesce(contains(url, '://'), false) as ok,
    regexp_extract(url, '^.*?://(.*)$', 1, 's') as rest,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
), named as (
  select page_id, url, host, path,
    case when ok then regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
      || case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end end as canonical
  from (select *, list_filter(string_split(regexp_extract(regexp_replace(rest, '#.*$', '', 's'), '^[^?]*\?(.*)$', 1, 's'), '&'),
      lambda p: p <> '' and not regexp_matches(p, '{url_filter.TRACKING}')) as q from parts)
), entries as (
  select distinct canonical from named
  where cast('0x' || substr(md5(url), 1, 2) as integer) < {LISTED_BYTES} and canonical is not null
), fits as (
  select *, canonical in (select canonical from entries) and canonical is not null as listed, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from named
)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when listed then 'block' else 'allow' end as verdict, canonical, coalesce(listed, false) as listed
from fits
"""


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(table(spark, sf_dir, "documents"))


TOXIC_CATEGORIES = ["low_quality", "toxic"]  # in the order of the chain


def label_table(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, label_table(table(spark, sf_dir, "labels")), TOXIC_CATEGORIES)
    return toxicity.score(docs, chain, TOXIC_CATEGORIES).drop("text")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = warc.write(pages, scratch_path(spark, "warc"))
    return warc.read(spark, files, 4 << 20).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP5_SQL = """
with rows as (select page_id, coalesce(html, '') as payload from pages),
firsts as (select payload, min(page_id) as first_id from rows where strlen(payload) >= 100 group by payload)
select r.page_id, cast(strlen(r.payload) as bigint) as payload_bytes, sha256(r.payload) as payload_digest,
  case when r.page_id > f.first_id then 'revisit' else 'response' end as record_type,
  case when r.page_id > f.first_id then f.first_id end as refers_to
from rows r left join firsts f on r.payload = f.payload
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens", "token_score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False).drop("ids")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.rules(docs).drop("text", "lang")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


SPACES = r"[\x20\x09-\x0D]+"


def repeated_tails(docs: DataFrame) -> DataFrame:
    """`docs` as the query wants them: of one document in ten the words from one place on repeat."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    some = docs.withColumn("__h", h).withColumn("__g", F.expr("__h div 10"))
    some = some.withColumn("__words", F.when((F.col("__h") % 10 == 0) & F.col("text").isNotNull(), words))
    some = some.withColumn("__n", F.size("__words")).withColumn("__a", F.expr("cast(__g % nullif(__n, 0) as int)"))
    some = some.withColumn("__p", F.expr("cast(1 + (__n - __a) div (3 + __g % 8) as int)"))
    head = F.slice("__words", F.lit(1), F.col("__a"))
    tail = F.expr("transform(sequence(0, __n - __a - 1), i -> __words[__a + i % __p])")
    text = F.when(F.col("__n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return some.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def run_sql(levels: int = 12) -> str:
    """The runs in SQL: names of all grams by doubling, neighbouring occurrences, then islands of equal lags.

    `levels` levels hold periods up to (3 ** levels - 1) / 2, runs of four times as many words.
    """
    steps, firsts, first = [], [], 1
    for _ in range(levels):
        firsts.append((first, max(6, 4 * first) - first))
        first = firsts[-1][1] + 1
    width = 1
    for first, size in firsts:
        while 2 * width <= size:
            steps.append(
                f"g{2 * width} as (select rid, i, dense_rank() over (order by a, b) as name from (select rid, i, name as a,"
                f" lead(name, {width}) over (partition by rid order by i) as b from g{width}) where b is not null)"
            )
            width *= 2
        steps.append(
            f"l{first} as (select rid, i, j - i as lag from (select rid, i, lead(i) over (partition by rid, a, b order by i) as j from ("
            f"select rid, i, name as a, lead(name, {size - width}) over (partition by rid order by i) as b from g{width})"
            f" where b is not null) where j - i between {first} and {size})"
        )
        steps.append(
            f"r{first} as (select rid, min(i) as s, max(i) - min(i) + {size} + lag as len, lag from (select *, i - row_number()"
            f" over (partition by rid, lag order by i) as island from l{first}) group by rid, lag, island"
            f" having len >= greatest(6, 4 * lag))"
        )
    runs = " union all ".join(f"select * from r{first}" for first, _ in firsts)
    named = ",\n".join(step.replace(" as (", " as materialized (", 1) for step in steps)
    return f"""
with hashed as (
  select row_number() over () - 1 as rid, doc_id, text, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''),
      lambda c: list_transform(range(8), lambda k: (cast(ord(c) as bigint) >> cast(k as int)) & 1))),
    lambda c, b: xor(c >> 1, case when xor(c & 1, b) = 1 then 3988292384 else 0 end), 4294967295::bigint)) as h
  from documents
), split as (
  select rid, doc_id, h, h // 10 as g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from hashed
), placed as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then g % len(w) else len(w) end as a,
    1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) as p from split
), words as materialized (
  select rid, i, w[1 + case when i < a then i else a + (i - a) % p end] as word
  from (select rid, w, a, p, unnest(range(n)) as i from placed)
), g1 as materialized (select rid, i, dense_rank() over (order by word) as name from words),
{named},
runs as materialized ({runs}),
dropped as (select distinct rid, i from (select rid, unnest(range(s + lag, s + len)) as i from runs)),
kept as (
  select w.rid, string_agg(word, ' ' order by w.i) as text from words w left join dropped d on w.rid = d.rid and w.i = d.i
  where d.i is null group by w.rid
), told as (
  select rid, count(*) as n_runs, string_agg(s || ',' || len || ',' || lag || chr(10), '' order by s, lag) as lines,
    first(s order by len desc, s, lag) as start, first(len order by len desc, s, lag) as length, first(lag order by len desc, s, lag) as period
  from runs group by rid
)
select p.doc_id, cast(coalesce(t.n_runs, 0) as bigint) as n_runs, cast(t.start as bigint) as start, cast(t.length as bigint) as length,
  cast(t.period as bigint) as period, cast(1000 * t.length // t.period as bigint) as exponent_milli,
  sha256(coalesce(t.lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from placed p left join told t on p.rid = t.rid left join kept k on p.rid = k.rid
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, "embedding")
    placed = whitening.transform(vectors, model, "embedding")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return placed.withColumn("n", F.lit(model.n).cast("long")).withColumn("shares", shares).select(
        "vec_id", F.posexplode("whitened").alias("at", "whitened"), "n", "deviation", "shares"
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.expr("shares[at]").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shard(docs, scratch_path(spark, "shards"), SHARDS)
    return dealt.select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce(F.col("record.text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_shingle_join": op4_shingle_join,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_language_model": op8_language_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}
SQL = {"op2_url_filter": OP2_SQL, "op5_warc": OP5_SQL, "op11_periodic_runs": run_sql()}
