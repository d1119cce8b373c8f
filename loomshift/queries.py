"""Registry of the queries over the reference's operators, each with its SQL.

Every query runs over whole tables. Rejects are planted by expressions that Spark and the SQL share, as the tables have none.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import temporal
from .functions.keys import keyset_after
from .functions.names import identifier_words
from .operators import load, match, profile, reconcile, summary
from .plans import plan, preflight, report, runner
from .plans.constraints import constraints_of, rules_from
from .sources import catalog
from .sources.scratch import checkpoint_folder
from .streaming import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    select o_custkey, count(*) as orphans from orders o
    where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_custkey % 10 <> 0)
    group by o_custkey""")
def fk_orphans(spark, sf_dir):
    """Orders whose customer is missing from a filtered parent."""
    key = catalog.ForeignKey("FK_CUSTOMER", ["o_custkey"], "customer", ["c_custkey"])
    found = catalog.orphans(t(spark, sf_dir, "orders"), key, t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"))
    return found.groupBy("o_custkey").agg(F.count("*").alias("orphans"))


flagship = fk_orphans


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    return " union all ".join(f"""select '{c}' as "column", count(*) as sampled_rows, count(*) filter ({c} is null) as nulls, count(distinct {c}) as distinct_values,
        case when length(min({c})::varchar) > 40 then substr(min({c})::varchar, 1, 39) || '…' else min({c})::varchar end as min_text,
        case when length(max({c})::varchar) > 40 then substr(max({c})::varchar, 1, 39) || '…' else max({c})::varchar end as max_text,
        {f"max(length(rtrim({c}, ' ')))::int" if s else "null::int"} as max_len, {f"round(avg(length(rtrim({c}, ' '))), 6)" if s else "null::double"} as avg_len from {table}""" for c, s in columns.items())


@query(_profile_sql("orders", {"o_orderkey": False, "o_custkey": False}))
def profile_numeric(spark, sf_dir):
    return profile.column_profiles(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@query(_profile_sql("customer", {"c_name": True, "c_mktsegment": True}))
def profile_string(spark, sf_dir):
    return profile.column_profiles(t(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))


@query("""
    with v as (select 'p_name' as "column", p_name as value from part union all select 'p_brand', p_brand from part),
    m as (select "column", regexp_replace(regexp_replace(regexp_replace(substr(value, 1, 64), '\\p{Lu}', 'A', 'g'), '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]', 'a', 'g'), '\\p{Nd}', '9', 'g') as s from v where trim(value) <> ''),
    p as (select "column", array_to_string(list_filter(list_transform(range(1, length(s) + 1), lambda i: case when i > 1 and substr(s, i, 1) = substr(s, i - 1, 1) then '' else substr(s, i, 1) end), lambda x: x <> ''), '') as pattern from m),
    c as (select "column", pattern, count(*) as n from p group by all),
    r as (select *, row_number() over (partition by "column" order by n desc, pattern) as rank from c)
    select "column", pattern, n, rank from r where rank <= 3""")
def top_patterns(spark, sf_dir):
    return profile.top_patterns(t(spark, sf_dir, "part"), ["p_name", "p_brand"])


#: Columns made of customers' keys: by name, an expression that both dialects read, the class, and which keys get no such value.
_CLASSED = {
    "mail": ("concat('user', c_custkey, '@mail.example')", "email", 7), "mixed": ("concat('user', c_custkey, '@mail.example')", "email", 3),
    "guid": ("concat(lpad(cast(c_custkey as varchar(20)), 8, '0'), '-1111-2222-3333-444455556666')", "guid", 9), "phone": ("concat('+1 555 ', lpad(cast(c_custkey as varchar(20)), 7, '0'))", "phone", 6),
    "zip": ("lpad(cast(c_custkey % 99999 as varchar(20)), 5, '0')", "postal_code", 8), "country": ("case c_custkey % 3 when 0 then 'DE' when 1 then 'FR' else 'US' end", "country_code", 11),
    "flag": ("case c_custkey % 2 when 0 then 'Y' else 'n' end", "flag", 10), "day": ("concat('2024-01-', lpad(cast(1 + c_custkey % 28 as varchar(20)), 2, '0'))", "date", 12),
    "moment": ("concat('2024-01-', lpad(cast(1 + c_custkey % 28 as varchar(20)), 2, '0'), 'T10:00:00Z')", "datetime", 13), "whole": ("cast(c_custkey + 1000000 as varchar(20))", "integer", 14),
    "part": ("concat(c_custkey, '.25')", "decimal", 15), "site": ("concat('https://example.org/', c_custkey)", "url", 16), "name": ("c_name", "text", 5),
}


def _classed(name: str) -> str:
    value, _, odd = _CLASSED[name]
    return f"case when c_custkey % {odd} = 0 then 'none of these' else {value} end"


@query(" union all ".join(f"""select '{n}' as "column", case when 5 * count(*) filter (c_custkey % {odd} <> 0) >= 4 * count(*) then '{kind}' else 'text' end as class from customer""" for n, (_, kind, odd) in _CLASSED.items())
    + """ union all select 'url', case when 5 * count(*) filter (regexp_matches(url, '(?i)^((https?|ftp)://|www\\.)\\S+$')) >= 4 * count(*) then 'url' else 'text' end from pages""")
def semantic_class(spark, sf_dir):
    """All eleven classes, each with some values of none; and one column whose share is too low."""
    customers = t(spark, sf_dir, "customer").select(*(F.expr(_classed(n)).alias(n) for n in _CLASSED))
    return profile.semantic_classes(customers, list(_CLASSED)).unionByName(profile.semantic_classes(t(spark, sf_dir, "pages"), ["url"]))


@query("""
    select "column", nulls / sampled_rows as null_ratio from (
        select 'rare' as "column", count(*) as sampled_rows, count(*) filter (o_orderkey % 50 <> 0) as nulls from orders
        union all select 'often', count(*), count(*) filter (o_orderkey % 3 = 0) from orders) where nulls / sampled_rows > 0.95""")
def null_heavy(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.when(F.expr("o_orderkey % 50 = 0"), F.col("o_custkey")).alias("rare"), F.when(F.expr("o_orderkey % 3 <> 0"), F.col("o_custkey")).alias("often"))
    return profile.with_ratios(profile.column_profiles(orders)).where("null_ratio > 0.95").select("column", "null_ratio")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_chunk_key(spark, sf_dir):
    return profile.duplicate_keys(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select conv_id, turn, role from conversations where (conv_id > 5) or (conv_id = 5 and turn > 1) order by conv_id, turn limit 100")
def keyset_page(spark, sf_dir):
    """A page of a keyset scan; the limit is the page's size."""
    return t(spark, sf_dir, "conversations").where(keyset_after(["conv_id", "turn"], [5, 1])).orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", "role")


@query("""
    select *, (case when rn <= 1500 then ceil(rn / 500) else 3 + ceil((rn - 1500) / 500) end)::bigint as chunk
    from (select o_orderkey, o_custkey, o_orderpriority, row_number() over (order by o_orderkey) as rn from orders)""")
def chunk_numbering(spark, sf_dir):
    numbered = load.row_numbers(t(spark, sf_dir, "orders"), ["o_orderkey"])
    return numbered.select("o_orderkey", "o_custkey", "o_orderpriority", "rn", load.chunk_of(F.col("rn"), 500).alias("chunk"))


@query("""
    select chunk, count(*) as n from (select (case when rn <= 3000 then ceil(rn / 1000) else 3 + ceil((rn - 3000) / 100000) end)::bigint as chunk
    from (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from lineitem)) group by chunk""")
def chunk_sizes(spark, sf_dir):
    numbered = load.row_numbers(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return numbered.groupBy(load.chunk_of(F.col("rn"), 100_000).alias("chunk")).agg(F.count("*").alias("n"))


@query("select c_custkey, substr(c_name, 1, strpos(c_name, '#') - 1) as first_part, substr(c_name, strpos(c_name, '#') + 1) as last_part from customer")
def split_name(spark, sf_dir):
    at = F.locate("#", F.col("c_name"))
    return t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").substr(F.lit(1), at - 1).alias("first_part"), F.col("c_name").substr(at + 1, F.length("c_name")).alias("last_part"))


@query("select p_partkey, case when p_size > 25 then true else false end as is_large from part")
def flag_case(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, True).otherwise(False).alias("is_large"))


@query("""
    select o.o_orderkey, s.code as status_code from orders o join (values ('F', 'FINISHED'), ('O', 'OPEN'), ('P', 'PART')) s(k, code) on o.o_orderstatus = s.k""")
def lookup_merge(spark, sf_dir):
    """A merge query with its join as SQL text."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("loomshift_orders")
    return spark.sql("select s.o_orderkey, st.code as status_code from loomshift_orders as s join values ('F', 'FINISHED'), ('O', 'OPEN'), ('P', 'PART') as st(k, code) on s.o_orderstatus = st.k")


@query("select c_custkey, (select min(o_orderkey) from orders o where o.o_custkey = c.c_custkey) as first_order from customer c")
def primary_child(spark, sf_dir):
    return summary.least_child(t(spark, sf_dir, "customer"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "first_order").select("c_custkey", "first_order")


def _rules(spark, sf_dir) -> load.Constraints:
    parent = t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select("c_custkey")
    return load.Constraints(types={"price": "int"}, max_length={"note": 8}, not_null=["status"], checks=["o_totalprice >= 20000"], foreign_keys=[load.ForeignKey(["o_custkey"], parent, ["c_custkey"])], primary_key=["key"])


def _source(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.when(F.expr("o_orderkey % 13 = 0"), F.lit("n/a")).otherwise(F.expr("cast(o_orderkey % 1000 as string)")).alias("price"),
        F.when(F.expr("o_orderkey % 17 <> 0"), F.col("o_orderstatus")).alias("status"), F.when(F.expr("o_orderkey % 19 = 0"), F.lit("much too long")).otherwise(F.lit("short")).alias("note"), F.expr("o_orderkey - o_orderkey % 2").alias("key"),
    )


_MARKED = """
    with s as (select o_orderkey, o_custkey, o_totalprice, case when o_orderkey % 13 = 0 then 'n/a' else (o_orderkey % 1000)::varchar end as price,
        case when o_orderkey % 17 <> 0 then o_orderstatus end as status, case when o_orderkey % 19 = 0 then 'much too long' else 'short' end as note, o_orderkey - o_orderkey % 2 as key from orders),
    f as (select s.*, case when try_cast(price as int) is null then 'conversion' when length(note) > 8 then 'truncation' when status is null then 'not_null'
        when o_totalprice < 20000 then 'check' when o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = s.o_custkey and c.c_custkey % 10 <> 0) then 'fk' end as fault from s),
    m as (select *, coalesce(fault, case when row_number() over (partition by key order by fault is not null, o_orderkey) > 1 then 'duplicate' end) as reason from f)
"""


@query(_MARKED + "select o_orderkey, key, reason from m where reason is not null")
def reject_split(spark, sf_dir):
    return load.mark_rejects(_source(spark, sf_dir), _rules(spark, sf_dir), ["o_orderkey"]).where("reason is not null").select("o_orderkey", "key", "reason")


@query(_MARKED + "select o_orderkey, key, status from m where reason is null")
def load_accepted(spark, sf_dir):
    return load.accepted(load.mark_rejects(_source(spark, sf_dir), _rules(spark, sf_dir), ["o_orderkey"])).select("o_orderkey", "key", "status")


@query(_MARKED + "select case reason when 'check' then 547 when 'fk' then 547 when 'duplicate' then 2627 end as number, reason, count(*) as rows from m where reason is not null group by all")
def reject_summary(spark, sf_dir):
    return load.reject_summary(load.rejects(load.mark_rejects(_source(spark, sf_dir), _rules(spark, sf_dir), ["o_orderkey"]), ["o_orderkey"]))


@query(_MARKED + ", c as (select case reason when 'check' then 547 when 'fk' then 547 when 'duplicate' then 2627 end as number, count(*) as rows from m where reason is not null group by 1) select number, rows from c order by rows desc, number is null, number limit 1")
def most_common_error(spark, sf_dir):
    return load.most_common_number(load.rejects(load.mark_rejects(_source(spark, sf_dir), _rules(spark, sf_dir), ["o_orderkey"]), ["o_orderkey"]))


def _one_reject(reason: str):
    def run(spark, sf_dir):
        return load.mark_rejects(_source(spark, sf_dir), _rules(spark, sf_dir), ["o_orderkey"]).where(F.col("reason") == reason).select("o_orderkey")

    run.__name__ = f"reject_{reason}"
    return query(_MARKED + f"select o_orderkey from m where reason = '{reason}'")(run)


for _reason in ("conversion", "truncation", "not_null", "check", "fk", "duplicate"):
    _one_reject(_reason)


@query("""
    with bad as (select o_orderkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_custkey % 10 <> 0))
    select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from bad) group by l_orderkey""")
def reject_cascade(spark, sf_dir):
    """Lines whose order was itself rejected."""
    parent = t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select("c_custkey")
    orders = load.accepted(load.mark_rejects(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load.Constraints(foreign_keys=[load.ForeignKey(["o_custkey"], parent, ["c_custkey"])]), ["o_orderkey"]))
    lines = load.mark_rejects(t(spark, sf_dir, "lineitem").select("l_orderkey"), load.Constraints(foreign_keys=[load.ForeignKey(["l_orderkey"], orders, ["o_orderkey"])]), ["l_orderkey"])
    return lines.where("reason = 'fk'").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
    select event_id, epoch_us(ts) as us, (floor((epoch_us(ts) + 500000) / 1000000) * 1000000)::bigint as rounded_us from (select event_id, ts + to_milliseconds((event_id % 1000)::int) as ts from events)""")
def temporal_round(spark, sf_dir):
    shifted = t(spark, sf_dir, "events").select("event_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.expr("event_id % 1000") * 1000).alias("ts"))
    return shifted.select("event_id", F.unix_micros("ts").alias("us"), F.unix_micros(temporal.round_to_scale(F.col("ts"), 0)).alias("rounded_us"))


@query("select event_id, epoch_us(date_trunc('minute', date_trunc('second', ts) + interval 30 seconds)) as minute_us from events")
def smalldatetime_round(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.unix_micros(temporal.to_minute(F.col("ts").cast("timestamp"))).alias("minute_us"))


_COPY = "select o_orderkey, case when o_orderkey % 100 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 77 <> 0"


def _copy(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").where("o_orderkey % 77 <> 0").select("o_orderkey", F.when(F.expr("o_orderkey % 100 = 0"), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query(f"""
    select (select count(*) from orders) as source_rows, (select count(*) from orders where o_orderkey % 77 = 0) as rejected_rows, (select count(*) from ({_COPY})) as target_rows,
        (select count(*) from orders) - (select count(*) from orders where o_orderkey % 77 = 0) = (select count(*) from ({_COPY})) as matched""")
def count_reconcile(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").agg(F.count("*").alias("source_rows"), F.count(F.when(F.expr("o_orderkey % 77 = 0"), 1)).alias("rejected_rows"))
    both = orders.join(F.broadcast(_copy(spark, sf_dir).agg(F.count("*").alias("target_rows"))))
    return both.withColumn("matched", F.col("source_rows") - F.col("rejected_rows") == F.col("target_rows"))


def _checksum_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(f"""select '{c}' as "column", count({c}) as values, sum(('0x' || substr(md5({c}::varchar), 1, 8))::bigint)::bigint as checksum from {source}""" for c in columns)


@query(_checksum_sql("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))
def column_checksum(spark, sf_dir):
    return reconcile.column_checksums(t(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(f"""
    select a."column", a.checksum is not distinct from b.checksum and a.values is not distinct from b.values as matched
    from ({_checksum_sql("orders", ["o_orderkey", "o_orderstatus"])}) a full join ({_checksum_sql(f"({_COPY})", ["o_orderkey", "o_orderstatus"])}) b on a."column" = b."column" """)
def checksum_compare(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus"]
    return reconcile.compare_checksums(reconcile.column_checksums(t(spark, sf_dir, "orders"), columns), reconcile.column_checksums(_copy(spark, sf_dir), columns))


@query(f"""
    select 'source' as side, count(*) as rows from (select o_orderkey, o_orderstatus from orders except {_COPY})
    union all select 'target', count(*) from ({_COPY} except select o_orderkey, o_orderstatus from orders)""")
def row_diff(spark, sf_dir):
    return reconcile.row_diff(t(spark, sf_dir, "orders"), _copy(spark, sf_dir), ["o_orderkey", "o_orderstatus"])


_EDGES = [("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region")]
_EDGE_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _EDGES)


@query(f"select table_key, count(*) as degree from (select c as table_key from (values {_EDGE_VALUES}) e(c, p) union all select p from (values {_EDGE_VALUES}) e(c, p)) group by table_key")
def fk_degree(spark, sf_dir):
    return match.degrees(spark.createDataFrame(_EDGES, "child string, parent string"))


_NAMES = [("s:CUST_NM", "customer name"), ("s:EMAIL_ADDR", "email address"), ("s:CRT_DT", "created date"), ("t:CustomerName", "customer name"), ("t:Email", "email"), ("t:CreatedAt", "created date")]


@query(f"""
    with d as (select * from (values {", ".join(f"('{a}', '{b}')" for a, b in _NAMES)}) v(doc, words)),
    j as (select doc, string_split(words, ' ') as tokens, '#' || replace(words, ' ', '#') || '#' as s from d),
    f as (select doc, unnest(list_concat(list_transform(tokens, lambda w: 'w:' || w), list_transform(range(1, length(s) - 1), lambda i: 'g:' || substr(s, i, 3)))) as feature from j),
    c as (select doc, feature, count(*) as tf from f group by all),
    i as (select feature, ln((1 + 6) / (1 + count(*))) + 1 as idf from c group by feature),
    r as (select doc, feature, tf * idf * case when feature like 'w:%' then 1.0 else 0.5 end as raw from c join i using (feature)),
    n as (select doc, sqrt(sum(raw * raw)) as len from r group by doc), w as (select doc, feature, raw / len as weight from r join n using (doc))
    select x.doc as a, y.doc as b, round(least(1.0, sum(x.weight * y.weight)), 6) as score from w x join w y using (feature) where x.doc like 't:%' and y.doc like 's:%' group by all""")
def tfidf_cosine(spark, sf_dir):
    docs = spark.createDataFrame(_NAMES, "doc string, words string").select("doc", F.split("words", " ").alias("tokens"))
    vectors = match.tfidf(docs)
    return match.cosine_pairs(vectors.where("doc like 't:%'"), vectors.where("doc like 's:%'")).withColumn("score", F.round("score", 6))


@query("""
    select p_brand, p_partkey, score, rank from (select p_brand, p_partkey, p_size / 50 as score, row_number() over (partition by p_brand order by p_size / 50 desc, p_partkey) as rank from part where p_size / 50 >= 0.2) where rank <= 3""")
def table_topk(spark, sf_dir):
    scores = t(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50).alias("score"))
    return match.top_k(scores, "p_brand", "p_partkey")


@query()
def greedy_assignment(spark, sf_dir):
    """Regions' nations to size classes of parts, one to one by score; sequential, so it has no SQL."""
    nation = t(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("target"))
    other = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("source"))
    pairs = nation.join(other, F.col("n_regionkey") == F.col("r")).withColumn("score", F.pmod(F.xxhash64("target", "source"), F.lit(1000)) / 1000).withColumn("name", F.lit(1.0))
    return match.greedy_by_group(pairs.select("n_regionkey", "target", "source", "score", "name"), "n_regionkey")


@query("""
    select event_id, event_type, count(*) over (partition by event_type order by ts range between interval 10 minutes preceding and current row) as n_window from events""")
def rate_window(spark, sf_dir):
    return progress.sliding_counts(t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", 600).select("event_id", "event_type", "n_window")


@query("select event_type, epoch_us(time_bucket(interval 1 hour, ts)) as start_us, count(*) as n from events group by all")
def windowed_rate(spark, sf_dir):
    return progress.windowed_rates(t(spark, sf_dir, "events"), "event_type", "ts", "1 hour").select("event_type", F.unix_micros(F.col("window_start").cast("timestamp")).alias("start_us"), "n")


@query("""
    select c as "column" from (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) a(c)
    where c not in ('c_custkey', 'c_name') and c not in ('c_acctbal')""")
def uncovered_columns(spark, sf_dir):
    every = spark.createDataFrame([(c,) for c in t(spark, sf_dir, "customer").columns], "column string")
    done = spark.createDataFrame([("c_custkey",), ("c_name",), ("c_acctbal",)], "column string")
    return every.join(done, "column", "left_anti")


@query("""
    with c as (select count(*) as n from orders union all select count(*) from lineitem union all select count(*) from customer)
    select sum(n)::bigint as rows, ceil(sum(n) / 50000 / 60 * 10) / 10 as minutes from c""")
def volume_estimate(spark, sf_dir):
    return summary.volume_estimate(summary.table_counts({n: t(spark, sf_dir, n) for n in ("orders", "lineitem", "customer")}))


@query("""
    select severity, count(*) as findings from (select case when o_totalprice > 200000 then 'high' when o_totalprice > 50000 then 'medium' else 'low' end as severity from orders) group by severity""")
def severity_counts(spark, sf_dir):
    level = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 50000, "medium").otherwise("low")
    return summary.by_severity(t(spark, sf_dir, "orders").select(level.alias("severity")))


@query("""
    select rule, count(*) as findings, list(object order by object) filter (place <= 3) as examples
    from (select o_orderpriority as rule, o_orderkey as object, row_number() over (partition by o_orderpriority order by o_orderkey) as place from orders) group by rule""")
def findings_by_rule(spark, sf_dir):
    return summary.by_rule(t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule"), F.col("o_orderkey").alias("object")))


@query("""
    with c as (select 'orders' as k, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'region', count(*) from region)
    select count(*) as tables, sum(n)::bigint as rows, count(*) filter (n = 0) as empty, max_by(k, n) as largest from c""")
def database_summary(spark, sf_dir):
    return summary.database_summary(summary.table_counts({n: t(spark, sf_dir, n) for n in ("orders", "lineitem", "region")}))


@query("""
    select l_orderkey, sum(l_extendedprice) as total, count(*) as lines from lineitem group by l_orderkey order by total desc, l_orderkey limit 15""")
def largest_first(spark, sf_dir):
    """A top-k report; the limit is the report's."""
    return summary.largest(t(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_extendedprice"))


SQL["largest_first"] = "select l_orderkey, round(sum(l_extendedprice), 2) as total, count(*) as lines from lineitem group by l_orderkey order by total desc, l_orderkey limit 15"


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest_row(spark, sf_dir):
    return summary.latest(t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
    select p_name, list_filter(string_split(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') as words, count(*) as n from part group by p_name""")
def name_words(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).select("p_name", identifier_words(F.lower("p_name")).alias("words"), "n")


@query("""
    select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as newest_first from orders qualify newest_first <= 5""")
def error_samples(spark, sf_dir):
    """At most five samples a group, as in the final report."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return summary.first_of_each(orders, "o_custkey", F.desc("o_orderkey"), "newest_first", 5).drop("o_custkey")


@query("""
    select n_name as name, list_value(lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) as words, count(*) as n
    from (select *, concat(p_type, upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) as n_name from part) group by all""")
def camel_words(spark, sf_dir):
    """Names of an acronym and two words without blanks, as in ECONOMYColdWidget."""
    two = [F.split("p_name", " ")[k] for k in (0, 1)]
    name = F.concat("p_type", *(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))) for w in two))
    return t(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n")).select("name", identifier_words(F.col("name")).alias("words"), "n")


# Whole runs: a plan is generated from a mapping and catalogs, and loaded into a target of its own.

_COLUMN = catalog.Column


def _target() -> catalog.Catalog:
    """Customers, their orders and the lines of these, with a cycle of keys between the first two."""
    customers = catalog.Table(
        "Customers", [_COLUMN("CustomerId", 0, "bigint", False), _COLUMN("Name", 1, "string", False), _COLUMN("FirstOrder", 2, "bigint")], primary_key=["CustomerId"],
        foreign_keys=[catalog.ForeignKey("FK_FIRST", ["FirstOrder"], "Orders", ["OrderId"])],
    )
    orders = catalog.Table(
        "Orders", [_COLUMN("OrderId", 0, "bigint", False), _COLUMN("CustomerId", 1, "bigint", False), _COLUMN("Total", 2, "double", False)], primary_key=["OrderId"],
        foreign_keys=[catalog.ForeignKey("FK_CUSTOMER", ["CustomerId"], "Customers", ["CustomerId"])], checks=["Total >= 20000"],
    )
    lines = catalog.Table("OrderLines", [_COLUMN("OrderId", 0, "bigint", False), _COLUMN("LineNumber", 1, "int", False)], foreign_keys=[catalog.ForeignKey("FK_ORDER", ["OrderId"], "Orders", ["OrderId"])])
    return catalog.Catalog("target", {x.key: x for x in (customers, orders, lines)})


def _mapping() -> dict:
    first = "(select min(o.o_orderkey) from orders o where o.o_custkey = s.c_custkey)"
    return {"tables": {
        "Customers": {"kind": "direct", "sources": ["customer"], "filter": "s.c_custkey % 10 <> 0", "columns": {"CustomerId": {"expr": "s.c_custkey"}, "Name": {"expr": "s.c_name"}, "FirstOrder": {"expr": first}}},
        "Orders": {"kind": "direct", "sources": ["orders"], "columns": {"OrderId": {"expr": "s.o_orderkey"}, "CustomerId": {"expr": "s.o_custkey"}, "Total": {"expr": "s.o_totalprice"}}},
        "OrderLines": {"kind": "direct", "sources": ["lineitem"], "columns": {"OrderId": {"expr": "s.l_orderkey"}, "LineNumber": {"expr": "s.l_linenumber"}}},
    }}


def _run_setup(spark, sf_dir, only: list[str] | None = None):
    """Source views, target catalog, plan and an empty store in the shared folder."""
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": []}
    source = catalog.read_catalog(spark, "source", sf_dir, {n: {"primary_key": k} for n, k in keys.items()}, count_rows=False)
    for name in keys:
        t(spark, sf_dir, name).createOrReplaceTempView(name)
    mapping, target = _mapping(), _target()
    if only:
        mapping["tables"] = {k: v for k, v in mapping["tables"].items() if k in only}
    made = plan.generate(mapping, source, target)
    return source, target, made, runner.Store(spark, f"{checkpoint_folder(spark).rstrip('/')}/target-{uuid.uuid4().hex}")


def _reported(spark, store: runner.Store, reports) -> DataFrame:
    out = report.report_frame(spark, reports)
    store.delete("")
    return out


_LOADED = """
    with c as (select c_custkey from customer where c_custkey % 10 <> 0),
    o as (select o_orderkey, o_totalprice >= 20000 and o_custkey in (select c_custkey from c) as good from orders),
    l as (select l_orderkey in (select o_orderkey from o where good) as good from lineitem),
    n as (select 'T01' as task, 'Customers' as target, count(*) as source_rows, count(*) as loaded from c
        union all select 'T02', 'Orders', count(*), count(*) filter (good) from o union all select 'T03', 'OrderLines', count(*), count(*) filter (good) from l)
"""


@query(_LOADED + "select task, target, source_rows, loaded, source_rows - loaded as rejected, 0::bigint as held_before, loaded as held_after, 'done' as status, true as balanced from n")
def run_skip(spark, sf_dir):
    """A plan of three tables in skip mode: rejected orders take their lines with them."""
    _, target, made, store = _run_setup(spark, sf_dir)
    return _reported(spark, store, runner.run_plan(spark, store, made, rules_from(spark, target, made)))


@query("select 'Orders' as target, 0::bigint as loaded, least(3000, count(*))::bigint as rejected, 'nothing loaded' as ended from orders")
def run_all_rejected(spark, sf_dir):
    """A check that no row meets: the guard ends the task after its first chunks."""
    _, target, made, store = _run_setup(spark, sf_dir, ["Orders"])
    target.tables["Orders"].checks, target.tables["Orders"].foreign_keys = ["Total < 0"], []
    task = made.tasks[0]
    try:
        runner.run_task(spark, store, task, constraints_of(spark, store, target, task, made), runner.Options())
        ended = "ran on"
    except runner.BadTask as bad:
        ended = "nothing loaded" if "nothing loaded" in str(bad) else str(bad)
    state = store.manifest("Orders", task.id)
    store.delete("")
    return spark.createDataFrame([("Orders", state["loaded"], state["rejected"], ended)], "target string, loaded long, rejected long, ended string")


@query("select 'again' as task, 'Orders' as target, n as source_rows, 0::bigint as loaded, n as rejected, n as held_before, n as held_after, 'done' as status, true as balanced from (select count(*) as n from orders)")
def run_all_duplicate(spark, sf_dir):
    """A second load of the same rows into a filled target: every row is a duplicate."""
    _, target, made, store = _run_setup(spark, sf_dir, ["Orders"])
    target.tables["Orders"].checks, target.tables["Orders"].foreign_keys = [], []
    task = made.tasks[0]
    runner.run_task(spark, store, task, constraints_of(spark, store, target, task, made), runner.Options())
    again = replace(task, id="again")
    return _reported(spark, store, [runner.run_task(spark, store, again, constraints_of(spark, store, target, again, made), runner.Options())])


@query("""
    select 'paused' as first_status, 'done' as status, n - held as loaded, held as rejected, n as rows, n as distinct_keys
    from (select count(*) as n, count(*) filter (o_orderkey % 100 = 0) as held from orders)""")
def run_resume(spark, sf_dir):
    """A target that holds some keys, a load that pauses after two chunks, and its resumption."""
    _, target, made, store = _run_setup(spark, sf_dir, ["Orders"])
    target.tables["Orders"].checks, target.tables["Orders"].foreign_keys = [], []
    task = made.tasks[0]
    task.chunk_size = 500
    held = replace(task, id="held", query=f"{task.query}\nWHERE s.o_orderkey % 100 = 0")
    runner.run_task(spark, store, held, constraints_of(spark, store, target, held, made), runner.Options())
    rules = constraints_of(spark, store, target, task, made)
    first = runner.run_task(spark, store, task, rules, runner.Options(stop_after=2))
    last = runner.run_task(spark, store, task, rules, runner.Options())
    rows, keys = store.read("Orders").agg(F.count("*"), F.count_distinct("OrderId")).first()
    store.delete("")
    return spark.createDataFrame([(first.status, last.status, last.loaded, last.rejected, rows, keys)], "first_status string, status string, loaded long, rejected long, rows long, distinct_keys long")


@query("""
    select s.code as status_code, count(*) as rows, min(o_orderkey) as first_order from orders o
    join (values ('F', 'FINISHED'), ('O', 'OPEN')) s(k, code) on o.o_orderstatus = s.k group by s.code""")
def lookup_load(spark, sf_dir):
    """A lookup task: staged rows meet a table that the target holds, and what has no match is left out."""
    source, _, _, store = _run_setup(spark, sf_dir, ["Orders"])
    spark.createDataFrame([("F", "FINISHED"), ("O", "OPEN")], "Code string, Name string").createOrReplaceTempView("status_list")
    states = catalog.Table("States", [_COLUMN("Code", 0, "string", False), _COLUMN("Name", 1, "string", False)], primary_key=["Code"])
    orders = catalog.Table("Orders", [_COLUMN("OrderId", 0, "bigint", False), _COLUMN("StatusName", 1, "string", False)], primary_key=["OrderId"])
    source.tables["status_list"] = catalog.Table("status_list", states.columns, primary_key=["Code"])
    mapping = {"tables": {
        "States": {"kind": "direct", "sources": ["status_list"], "columns": {"Code": {"expr": "s.Code"}, "Name": {"expr": "s.Name"}}},
        "Orders": {"kind": "lookup", "sources": ["orders"], "columns": {"OrderId": {"expr": "s.o_orderkey"}, "StatusName": {"expr": "s.o_orderstatus"}}, "reads": ["States"],
            "merge": "select g.OrderId, x.Name as StatusName, g.__k0 from stg g join States x on x.Code = g.StatusName"},
    }}
    target = catalog.Catalog("target", {"States": states, "Orders": orders})
    made = plan.generate(mapping, source, target)
    made.tasks.sort(key=lambda task: task.mode == "staging")
    runner.run_plan(spark, store, made, rules_from(spark, target, made))
    return store.read("Orders").groupBy(F.col("StatusName").alias("status_code")).agg(F.count("*").alias("rows"), F.min("OrderId").alias("first_order"))


@query(_LOADED + """
    select 'Customers' as child, 'FK_FIRST' as key, count(*) as orphans from (select min(o_orderkey) as first_order from orders where o_custkey in (select c_custkey from c) group by o_custkey)
    where first_order not in (select o_orderkey from o where good)""")
def fk_recheck(spark, sf_dir):
    """The foreign key that the load order cut, checked on what was loaded."""
    _, target, made, store = _run_setup(spark, sf_dir)
    runner.run_plan(spark, store, made, rules_from(spark, target, made))
    found = runner.verify_cut(store, made, target)
    store.delete("")
    return spark.createDataFrame(found, "child string, key string, orphans long")


@query("""
    select * from (values ('plan_valid', true, 'ok', false), ('source_connection', true, 'ok', false), ('target_connection', true, 'ok', false), ('source_drift', true, 'ok', false), ('target_drift', false, 'error', false),
    ('target_identity', true, 'ok', false), ('target_tables', true, 'ok', false), ('control_table', true, 'ok', false), ('target_rows', true, 'ok', false), ('estimated_rows', true, 'ok', false),
    ('chunk_keys', true, 'ok', false), ('keyless_tasks', false, 'warning', false)) v("name", ok, severity, not_run)""")
def preflight_checks(spark, sf_dir):
    """The checks before a run over an empty target of which the structure changed."""
    source, target, made, store = _run_setup(spark, sf_dir)
    return preflight.checks_frame(spark, preflight.preflight(spark, store, made, source, target, source_mark=catalog.fingerprint(source), target_mark="another"))


@query(_LOADED + """
    select 'Transferred ' || format('{:,}', sum(loaded)::bigint) || ' of ' || format('{:,}', sum(source_rows)::bigint) || ' rows into 3 tables in an unknown time ('
        || format('{:,}', sum(source_rows - loaded)::bigint) || ' rejected); row counts validated, checksums 3/3 matched.' as headline from n""")
def final_report(spark, sf_dir):
    _, target, made, store = _run_setup(spark, sf_dir)
    reports = runner.run_plan(spark, store, made, rules_from(spark, target, made))
    told = report.final_report(spark, store, made, reports, target.tables)
    store.delete("")
    return spark.createDataFrame([(told["headline"],)], "headline string")
