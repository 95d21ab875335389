"""One query for each relational operator of the engine, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import relational as R
from weftline.plans import pack_queries  # noqa: F401  registers its queries
from weftline.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from weftline.plans.statements import verdict_rules

digest = lambda c: F.sha2(F.col(c), 256)
long = lambda c: F.col(c).cast("long")


@query("select klass, count(*) n from (select case when lower(url) like '%.net/%' then 'net' when lower(url) like '%//m.%' then 'mobile' else 'skipped' end klass from pages) group by klass", "pages")
def scan_classify(pages):
    url = F.lower("url")
    klass = S.first_label([(url.contains(".net/"), "net"), (url.contains("//m."), "mobile")], "skipped")
    return pages.groupBy(klass.alias("klass")).agg(F.count("*").alias("n"))


@query("select doc_id, n_chars from documents where n_chars > 500", "documents")
def scan_metadata_filter(documents):
    return documents.where("n_chars > 500").select("doc_id", "n_chars")


@query("select doc_id, sha256(text) digest from documents", "documents")
def digest_fold(documents):
    return documents.select("doc_id", digest("text").alias("digest"))


@query("select sha256(text) blob_id, min(doc_id) first_doc, count(*) refs from documents group by 1", "documents")
def content_addressed_upsert(documents):
    return documents.groupBy(digest("text").alias("blob_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("refs"))


@query(
    """select source, cast(sum(n_chars) as bigint) orig, cast(sum(case when rn = 1 then n_chars else 0 end) as bigint) stored
    from (select source, n_chars, row_number() over (partition by sha256(text) order by source, doc_id) rn from documents) group by source""",
    "documents",
)
def first_occurrence_cost(documents):
    # one pass: sums by blob and source, then which of a blob's sources comes first
    own = documents.groupBy(digest("text").alias("blob"), "source").agg(F.sum("n_chars").alias("orig"), F.min(F.struct("doc_id", "n_chars")).alias("first"))
    top = F.min(F.struct("source")).over(Window.partitionBy("blob"))
    rows = own.select("source", "orig", F.when(F.struct("source") == top, F.col("first.n_chars")).otherwise(0).alias("stored"))
    return rows.groupBy("source").agg(F.sum("orig").alias("orig"), F.sum("stored").alias("stored"))


@query(
    "select lang, source, cast(grouping(lang) as bigint) gl, cast(grouping(source) as bigint) gs, count(*) n, cast(sum(n_chars) as bigint) orig from documents group by rollup(lang, source)",
    "documents",
)
def stats_rollup(documents):
    sums = documents.rollup("lang", "source").agg(F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.count("*").alias("n"), F.sum("n_chars").alias("orig"))
    return sums.select("lang", "source", long("gl").alias("gl"), long("gs").alias("gs"), "n", "orig")


@query("select l_suppkey, case when sum(l_tax) > 0 then round(sum(l_quantity) / sum(l_tax), 4) else 0 end ratio from lineitem group by l_suppkey", "lineitem")
def ratio_guarded(lineitem):
    sums = lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"))
    return sums.select("l_suppkey", F.round(S.guarded_ratio(F.col("q"), F.col("t")), 4).alias("ratio"))


@query(
    """with a as (select l_orderkey k, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) ident from lineitem group by 1),
    b as (select l_partkey k, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) ident from lineitem group by 1)
    select a.k, count(b.k) matches from a left join b on a.ident = b.ident group by a.k""",
    "lineitem",
)
def identity_set_join(lineitem):
    part = F.concat("l_returnflag", "l_linestatus").alias("part")
    rows = lineitem.select("l_orderkey", "l_partkey", part)
    orders = R.with_identity(rows, ["l_orderkey"], F.col("part"))
    parts = R.with_identity(rows, ["l_partkey"], F.col("part"))
    return R.match_counts(orders, parts, "identity").select(F.col("l_orderkey").alias("k"), "matches")


@query(
    "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1",
    "orders",
)
def argmax_per_group(orders):
    return R.first_by(orders, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query(
    """select k, t, c from (select k, t, c, row_number() over (partition by k order by c desc, fp, t) rn
    from (select l_orderkey k, l_returnflag t, count(*) c, min(l_linenumber) fp from lineitem group by 1, 2)) where rn = 1""",
    "lineitem",
)
def mode_first_seen(lineitem):
    return R.mode_first_seen(lineitem, ["l_orderkey"], "l_returnflag", "l_linenumber").toDF("k", "t", "c")


@query(
    """select p_brand, max(case when r = 1 and n = 1 then p_partkey end) winner from
    (select p_brand, p_partkey, r, count(*) over (partition by p_brand, r) n from
    (select p_brand, p_partkey, rank() over (partition by p_brand order by p_size desc, p_retailprice) r from part)) group by p_brand""",
    "part",
)
def unique_winner(part):
    return R.unique_winner(part, ["p_brand"], [-F.col("p_size"), F.col("p_retailprice")], "p_partkey")


@query("select a.n an, b.n bn from (select distinct p_name n from part) a join (select distinct left(p_name, 3) n from part) b on starts_with(a.n, b.n) or starts_with(b.n, a.n)", "part")
def prefix_theta_join(part):
    names, heads = part.select(F.col("p_name").alias("an")).distinct(), part.select(F.substring("p_name", 1, 3).alias("bn")).distinct()
    return R.prefix_pairs(names, heads, "an", "bn").select("an", "bn")


@query(
    """select o_orderkey, case when ref is not null then c_custkey else (select min(c_custkey) from customer) end resolved
    from (select o_orderkey, case when o_orderstatus = 'P' then null when o_orderpriority like '5%' then -1 else o_custkey end ref from orders) left join customer on ref = c_custkey""",
    "orders",
    "customer",
)
def lookup_with_default(orders, customer):
    ref = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderpriority").startswith("5"), F.lit(-1)).otherwise(F.col("o_custkey"))
    least = customer.agg(F.min("c_custkey")).first()[0]
    rows = orders.select("o_orderkey", ref.cast("long").alias("ref"))
    return R.lookup_or_default(rows, customer, "ref", "c_custkey", F.lit(least), "resolved").select("o_orderkey", "resolved")


@query(
    """select coalesce(a.t, b.t) t, case when a.t is null or b.t is null then 'incompatible' when a.m = b.m then 'equal' else 'override' end st
    from (select p_type t, max(p_size) m from part where p_brand = 'Brand#2' group by 1) a full join (select p_type t, max(p_size) m from part where p_brand = 'Brand#4' group by 1) b on a.t = b.t""",
    "part",
)
def map_full_compare(part):
    side = lambda brand: part.where(F.col("p_brand") == brand).groupBy(F.col("p_type").alias("t")).agg(F.max("p_size").alias("m"))
    return R.full_compare(side("Brand#2"), side("Brand#4"), "t", "m", "incompatible", "incompatible", "override", "equal").toDF("t", "st")


@query(
    "with k as (select l_orderkey, string_agg(l_returnflag, ',' order by l_linenumber, l_returnflag) ck from lineitem group by l_orderkey) select ck, count(*) n from k group by ck", "lineitem"
)
def ordered_congruence(lineitem):
    flags = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    keys = lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(flags, lambda x: x["l_returnflag"]), ",").alias("ck"))
    return keys.groupBy("ck").agg(F.count("*").alias("n"))


@query("select a.event_id, xor(a.user_id, b.user_id) x, cast(case when a.user_id = b.user_id then 0 else 1 end as bigint) nz from events a join events b on a.event_id + 1 = b.event_id", "events")
def positional_xor(events):
    after = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("other"))
    both = events.select("event_id", "user_id").join(after, "event_id").withColumn("x", F.col("user_id").bitwiseXOR(F.col("other")))
    return both.select("event_id", "x", (F.col("x") != 0).cast("long").alias("nz"))


@query(
    "select a.doc_id a_id, b.doc_id b_id from (select sha256(text) h, min(doc_id) doc_id from documents group by 1) a join documents b on a.h = sha256(b.text) and a.doc_id < b.doc_id", "documents"
)
def digest_link_join(documents):
    rows = documents.select("doc_id", digest("text").alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("a_id"))
    return rows.join(first, "h").where("a_id < doc_id").select("a_id", F.col("doc_id").alias("b_id"))


@query(
    """select coalesce(a.k, b.k) k, case when a.k is null then 'extra' when b.k is null then 'missing' when a.h <> b.h then 'mismatch' else 'ok' end st
    from (select doc_id k, sha256(text) h from documents where n_chars > 300) a
    full join (select doc_id k, sha256(case when lang = 'es' then lang else text end) h from documents where lang <> 'fr') b on a.k = b.k""",
    "documents",
)
def closure_reconcile(documents):
    attested = documents.where("n_chars > 300").select(F.col("doc_id").alias("k"), digest("text").alias("h"))
    found = documents.where("lang <> 'fr'").select(F.col("doc_id").alias("k"), F.sha2(F.when(F.col("lang") == "es", F.col("lang")).otherwise(F.col("text")), 256).alias("h"))
    return R.full_compare(attested, found, "k", "h", "missing", "extra", "mismatch", "ok").toDF("k", "st")


@query(
    "select 'customer' kind, o_custkey id from orders where o_totalprice > 100000 union select 'nation', c_nationkey from orders join customer on o_custkey = c_custkey where o_totalprice > 100000",
    "orders",
    "customer",
)
def dependency_closure(orders, customer):
    used = orders.where("o_totalprice > 100000").select("o_custkey").distinct()
    nations = used.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("nation").alias("kind"), long("c_nationkey").alias("id")).distinct()
    return used.select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id")).unionByName(nations)


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')", "orders", "customer")
def keep_semi(orders, customer):
    urgent = orders.where(F.col("o_orderpriority").startswith("1"))
    return customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')", "orders", "customer")
def drop_anti(orders, customer):
    urgent = orders.where(F.col("o_orderpriority").startswith("1"))
    return customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(
    """with b as (select o_orderkey, case when o_totalprice > 400000 then 'X' else o_orderstatus end o_orderstatus from orders)
    select side, count(*) n from (select 'removed' side, * from (select o_orderkey, o_orderstatus from orders except all select * from b)
    union all select 'added', * from (select * from b except all select o_orderkey, o_orderstatus from orders)) group by side""",
    "orders",
)
def manifest_drift(orders):
    before = orders.select("o_orderkey", "o_orderstatus")
    after = orders.select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return R.drift(before, after).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "select case when count(*) = 0 then 'ok' else 'REFUSED' end verdict, count(*) changed from documents a join (select doc_id, case when n_chars > 9000 then n_chars + 1 else n_chars end n from documents) b on a.doc_id = b.doc_id where a.n_chars <> b.n",
    "documents",
)
def snapshot_witness(documents):
    later = documents.select("doc_id", (F.col("n_chars") + (F.col("n_chars") > 9000).cast("long")).alias("n"))
    changed = documents.select("doc_id", "n_chars").join(later, "doc_id").where("n_chars <> n").agg(F.count("*").alias("changed"))
    return changed.select(F.when(F.col("changed") == 0, "ok").otherwise("REFUSED").alias("verdict"), "changed")


@query(
    """select verdict, count(*) n from (select case when l_returnflag = 'A' then 'ok' when l_linestatus = 'O' then 'tamper-evident' when l_discount > 0.05 then 'inconclusive-deterministic' else 'inconclusive' end verdict from lineitem) group by verdict""",
    "lineitem",
)
def build_identity_verdict(lineitem):
    verdict = S.first_label(*verdict_rules(F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", F.col("l_discount") > 0.05))
    return lineitem.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """with f as (select event_id, ts, cast(floor(abs(value) * 100) as bigint) sz from events), t as (select sum(sz) total from f),
    r as (select event_id, sz, coalesce(sum(case when event_id <> 42 then sz else 0 end) over (order by ts, event_id rows between unbounded preceding and 1 preceding), 0) before from f)
    select event_id, sz from r cross join t where event_id <> 42 and total - before > total * 0.75""",
    "events",
)
def lru_eviction(events):
    files = events.select("event_id", "ts", F.floor(F.abs("value") * 100).cast("long").alias("sz"))
    return R.evict_oldest(files, "ts", "event_id", "sz", lambda total: total * 0.75, F.col("event_id") == 42).select("event_id", "sz")


@query(
    """with s as (select p_partkey, cast(case when p_name = 'ring' then 1 when right(p_name, 5) = ' ring' then 2 when p_type = 'SMALL' then 3 end as bigint) step from part)
    select p_partkey, step from s where step = (select min(step) from s)""",
    "part",
)
def priority_step(part):
    steps = [F.col("p_name") == "ring", F.col("p_name").endswith(" ring"), F.col("p_type") == "SMALL"]
    return R.first_matching_step(part, steps).select("p_partkey", long("step").alias("step"))


@query("select c_nationkey, count(*) n, string_agg(c_name, ',' order by c_name) candidates from customer where c_acctbal > 9000 group by c_nationkey having count(*) > 1", "customer")
def ambiguity_refusal(customer):
    return customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"), R.sorted_list("c_name").alias("candidates")).where("n > 1")


@query(
    "select l_orderkey, cast(l_linenumber as bigint) l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) rn from lineitem where l_discount > 0.05) where rn = 1",
    "lineitem",
)
def ordered_first_success(lineitem):
    return lineitem.where("l_discount > 0.05").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("l_linenumber"))


@query("select l_orderkey, bool_and(l_discount <= 0.09) ok from lineitem group by l_orderkey", "lineitem")
def all_or_nothing_gate(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_discount") <= 0.09).alias("ok"))


@query("select l_orderkey, cast(l_linenumber as bigint) l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1", "lineitem")
def duplicate_key_check(lineitem):
    return lineitem.groupBy("l_orderkey", long("l_linenumber").alias("l_linenumber")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    "select page_id, concat(case when url like '%..%' then 'traversal;' else '' end, case when url not like 'https://%' then 'scheme;' else '' end, case when url like '%#%' then 'fragment;' else '' end) reasons from pages",
    "pages",
)
def rule_violations(pages):
    url = F.col("url")
    return pages.select("page_id", F.array_join(S.reasons((url.contains(".."), "traversal;"), (~url.startswith("https://"), "scheme;"), (url.contains("#"), "fragment;")), "").alias("reasons"))


@query("select page_id, regexp_extract(url, '^https?://([A-Za-z0-9.-]+)/', 1) host from pages", "pages")
def url_capture(pages):
    return pages.select("page_id", F.regexp_extract("url", "^https?://([A-Za-z0-9.-]+)/", 1).alias("host"))


@query(
    "select p_partkey, upper(regexp_extract(p_name, ' ([a-z]+)$', 1)) suffix, case when p_name like '% %' then left(p_name, length(p_name) - length(regexp_extract(p_name, ' ([a-z]+)$', 1)) - 1) else p_name end stem from part",
    "part",
)
def name_stem(part):
    tail = F.regexp_extract("p_name", " ([a-z]+)$", 1)
    stem = F.when(F.col("p_name").contains(" "), F.substring(F.col("p_name"), F.lit(1), F.length("p_name") - F.length(tail) - 1)).otherwise(F.col("p_name"))
    return part.select("p_partkey", F.upper(tail).alias("suffix"), stem.alias("stem"))


@query(
    """select a.c_custkey, cast(coalesce(list_max(list_filter(range(0, least(length(a.c_name), length(b.c_name)) + 1), lambda i: left(a.c_name, cast(i as int)) = left(b.c_name, cast(i as int)))), 0) as bigint) lcp
    from customer a join customer b on a.c_custkey + 1 = b.c_custkey""",
    "customer",
)
def lcp_length(customer):
    after = customer.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next"))
    return customer.join(after, "c_custkey").select("c_custkey", S.common_prefix_length(F.col("c_name"), F.col("next")).cast("long").alias("lcp"))


@query(
    "select doc_id, case when n_chars < 1024 then 'B' when n_chars < 1048576 then 'KiB' else 'MiB' end unit, cast(case when n_chars < 1024 then n_chars else floor(n_chars * 10 / 1024.0) end as bigint) v from documents",
    "documents",
)
def human_size(documents):
    n = F.col("n_chars")
    unit = F.when(n < 1024, "B").when(n < 1048576, "KiB").otherwise("MiB")
    return documents.select("doc_id", unit.alias("unit"), F.when(n < 1024, n).otherwise(F.floor(n * 10 / 1024.0)).cast("long").alias("v"))


@query("select doc_id, cast(floor((n_chars + 31) / 32.0) as bigint) * 32 aligned, (n_chars > 0 and (n_chars & (n_chars - 1)) = 0) pow2 from documents", "documents")
def align_and_pow2(documents):
    return documents.select("doc_id", S.align_up(F.col("n_chars"), 32).alias("aligned"), S.is_power_of_two(F.col("n_chars")).alias("pow2"))


@query(
    """with s as (select sha256(text) h, min(doc_id) src from documents group by 1)
    select doc_id, case when lang is null then 'blob' when src = doc_id and n_chars > 2000 then 'blob' when src <> doc_id then 'exact' when n_chars > 200 then 'near' else 'blob' end plan_kind
    from documents join s on sha256(text) = s.h""",
    "documents",
)
def plan_ladder(documents):
    rows = documents.select("doc_id", "lang", "n_chars", digest("text").alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("src"))
    kind = (
        F.when(F.col("lang").isNull(), "blob")
        .when((F.col("src") == F.col("doc_id")) & (F.col("n_chars") > 2000), "blob")
        .when(F.col("src") != F.col("doc_id"), "exact")
        .when(F.col("n_chars") > 200, "near")
        .otherwise("blob")
    )
    return rows.join(first, "h").select("doc_id", kind.alias("plan_kind"))


@query("select event_type, count(*) n from events group by event_type", "events")
def plan_counts(events):
    return events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


@query("select user_id, cast(sum(case when event_type = 'error' then 0 else 1 end) as bigint) passed, count(*) total, round(sum(value), 2) secs from events group by user_id", "events")
def sum_and_count_if(events):
    return events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("passed"), F.count("*").alias("total"), F.round(F.sum("value"), 2).alias("secs"))


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) names from nation group by n_regionkey", "nation")
def sorted_name_list(nation):
    return nation.groupBy("n_regionkey").agg(R.sorted_list("n_name").alias("names"))


@query("select doc_id, left(sha256(text), 16) head, right(sha256(text), 8) tail from documents", "documents")
def head_tail_text(documents):
    rows = documents.select("doc_id", digest("text").alias("h"))
    return rows.select("doc_id", F.left("h", F.lit(16)).alias("head"), F.right("h", F.lit(8)).alias("tail"))


@query("select event_id, ts from events order by ts, event_id limit 20", "events")
def topk_by_mtime(events):
    return events.select("event_id", "ts").orderBy("ts", "event_id").limit(20)


@query("select user_id from events where event_type = 'view' and value > 200 except select user_id from events where event_type = 'error' and value > 200", "events")
def set_difference(events):
    high = events.where("value > 200")
    return high.where("event_type = 'view'").select("user_id").subtract(high.where("event_type = 'error'").select("user_id"))


@query(
    "select kind, id, row_number() over (order by kind, id) ord from (select cast(0 as bigint) kind, s_suppkey id from supplier union all select cast(1 as bigint), cast(r_regionkey as bigint) from region)",
    "supplier",
    "region",
)
def bag_union_ord(supplier, region):
    rows = supplier.select(F.lit(0).cast("long").alias("kind"), F.col("s_suppkey").alias("id")).unionByName(region.select(F.lit(1).cast("long").alias("kind"), long("r_regionkey").alias("id")))
    return R.running_sum(rows, ["kind", "id"], F.lit(1), "before").select("kind", "id", (F.col("before") + 1).cast("long").alias("ord"))


@query(
    "select page_id, case when url like '%ref%' then replace(url, 'ref', cast(page_id as varchar)) else concat(url, ' ', cast(page_id as varchar)) end cmd from pages", "pages"
)
def placeholder_subst(pages):
    args = F.array(F.replace("url", F.lit("ref"), F.lit("{}")))
    return pages.select("page_id", F.array_join(S.substitute(args, F.col("page_id").cast("string")), " ").alias("cmd"))


@query("select c_custkey, regexp_extract(concat('run --model-name ', c_name, ' out'), '--model-name ([^ ]+)', 1) v from customer", "customer")
def flag_token(customer):
    return customer.select("c_custkey", S.token_after(F.concat(F.lit("run --model-name "), "c_name", F.lit(" out")), "--model-name").alias("v"))


@query(
    """select l.l_orderkey, l.l_partkey, cast(l.l_linenumber as bigint) l_linenumber, case when o.o_orderkey is null then 'broken-leaf' when c.c_custkey is null then 'broken-root' else 'linked' end st
    from lineitem l left join orders o on l.l_orderkey = o.o_orderkey and o.o_orderstatus <> 'F' left join customer c on o.o_custkey = c.c_custkey and c.c_acctbal > 0""",
    "lineitem",
    "orders",
    "customer",
)
def two_edge_chain(lineitem, orders, customer):
    leaf = orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    root = customer.where("c_acctbal > 0").select("c_custkey")
    both = lineitem.select("l_orderkey", "l_partkey", long("l_linenumber").alias("l_linenumber")).join(leaf, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    both = both.join(root, F.col("o_custkey") == F.col("c_custkey"), "left")
    state = F.when(F.col("o_orderkey").isNull(), "broken-leaf").when(F.col("c_custkey").isNull(), "broken-root").otherwise("linked")
    return both.select("l_orderkey", "l_partkey", "l_linenumber", state.alias("st"))


@query("select event_id, json_extract_string(props, '$.k') k from events", "events")
def json_field(events):
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select doc_id, cast(strlen(text) as bigint) n_bytes, true restored, cast(0 as bigint) differing from documents where text is not null", "documents")
def xor_delta_roundtrip(documents):
    """Each text against a pad of its own length, made of its digest: delta, then text again, byte for byte."""
    from weftline.operators.bytes import delta_roundtrip

    n = F.octet_length("text")
    pad = F.left(F.repeat(digest("text"), F.ceil(n / 64.0).cast("int")), n).cast("binary")
    rows = documents.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("bytes"), pad.alias("pad"))
    rows = delta_roundtrip(rows, "bytes", "pad")
    # the delta's bytes that aren't 0 are those in which text and pad differ: none where they are the same text
    wrong = (F.col("differing") > F.octet_length("bytes")) | ((F.col("differing") == 0) & (F.col("bytes") != F.col("pad")))
    return rows.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), "restored", wrong.cast("long").alias("differing"))


@query("select doc_id, sha256(text) digest, true ok from documents where text is not null", "documents")
def blob_roundtrip_verify(documents):
    """Each text compressed, and decompressed to the same digest."""
    from weftline.operators.bytes import deflate_column, inflate_column

    rows = documents.where("text is not null").select("doc_id", digest("text").alias("digest"), deflate_column(F.col("text").cast("binary")).alias("blob"))
    return rows.select("doc_id", "digest", (F.sha2(inflate_column("blob"), 256) == F.col("digest")).alias("ok"))


@query(
    """select doc_id, case when lang = 'fr' then 'subject: unsafe name' when lang = 'de' then 'malformed quantType' when lang = 'es' then 'reDerivedDigest isn''t the subject''s: the statement contradicts itself' else '' end reasons
    from documents where text is not null""",
    "documents",
)
def statement_verify(documents):
    """A statement of derivation for each document, some of them broken, through the validation rules."""
    from weftline.plans.statements import DERIVATION, STATEMENT, check_statements

    sha, lang = digest("text"), F.col("lang")
    pin = lambda d: F.struct(d.alias("sha256")).alias("digest")
    subject = F.struct(F.when(lang == "fr", "../x").otherwise("x.gguf").alias("name"), pin(sha))
    recipe = F.struct(F.when(lang == "de", "--evil").otherwise("Q8_0").alias("quantType"), F.lit(False).alias("useImatrix"))
    again = F.struct(F.when(lang == "es", F.sha2("lang", 256)).otherwise(sha).alias("sha256"))
    predicate = F.struct(
        F.struct(F.lit("b.gguf").alias("name"), pin(sha)).alias("baseModel"),
        recipe.alias("recipe"),
        F.struct(F.struct(sha.alias("binarySha256")).alias("buildIdentity")).alias("builder"),
        F.struct(again.alias("reDerivedDigest")).alias("reproducibility"),
    )
    text = F.to_json(F.struct(F.lit(STATEMENT).alias("_type"), F.lit(DERIVATION).alias("predicateType"), F.array(subject).alias("subject"), predicate.alias("predicate")))
    rows = documents.where("text is not null").select("doc_id", text.alias("text"))
    return check_statements(rows, DERIVATION).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))
