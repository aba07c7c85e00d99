"""The engine's operators on the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions import predicate as P
from quietlog.functions.leaves import body, string_of
from quietlog.functions.text import masked_tokens
from quietlog.model import Effective, Implied, LogSource, Source
from quietlog.operators import accounting, implied, proof, templates
from quietlog.operators.alerts import Correlation, Rule, alerts
from quietlog.operators.drain import text_templates
from quietlog.operators.reduce import rebuild, reduced, removals, sized, summaries, volumes, with_bodies
from quietlog.plans import verify

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EVENTS = Source("events", LogSource("shop", "web"), event_type=("event_type",))
#: The events' body in DuckDB, members in order, and its parts.
VALUE = "cast(cast(value as decimal(18,2)) as varchar)"
BODY = f"""'{{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || ',"value":"' || {VALUE} || '"}}'"""
K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, over all cores: the work on a row outweighs its move. Larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log events with JSON bodies."""
    e = spread(table(spark, sf_dir, "events"))
    text = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"user_id":'), "user_id", F.lit(',"value":"'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit('"}'))
    return e.select("event_id", "ts", F.lit("events").alias("source"), body(text).alias("body"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.prepared(event_rows(spark, sf_dir), ("event_type",))


def with_template(df: DataFrame) -> DataFrame:
    """The event type as template: what kinds() gives here, without the pass over the data."""
    return df.withColumn("template_id", F.expr(string_of("leaves['event_type']")))


def records(df: DataFrame, source: str, key: str, fields: list[str]) -> DataFrame:
    """Rows of a table as events, their fields as JSON."""
    return df.select(F.col(key).cast("long").alias("event_id"), F.lit(source).alias("source"), body(F.to_json(F.struct(*fields))).alias("body"))


@query(f"""
with e as (select event_type, octet_length(encode({BODY})) as b from events), t as (select count(*) n from events)
select 'events' as source, 'event_type=' || event_type as discr, cast(count(*) as bigint) as events, cast(sum(b) as bigint) as bytes, cast(any_value(t.n) as bigint) as source_events,
  (count(*) < 100 or count(*) * 1000000 < 1000 * any_value(t.n)) as is_rare, cast(1 as bigint) as variants, cast(count(*) * 1000000 // any_value(t.n) as bigint) as share_ppm
from e, t group by event_type""")
def template_volumes(spark, sf_dir):
    """The flagship: templates of the events, their volumes and shares."""
    return templates.template_volumes(templates.kinds(templates.shapes(prepared(spark, sf_dir)))).drop("template_id")


@query("""
select path, kind, cast(count(*) as bigint) as n from events, (values ('event_type','string'), ('props.k','int'), ('user_id','int'), ('value','string')) v(path, kind) group by path, kind""")
def leaf_paths(spark, sf_dir):
    return templates.leaf_paths(prepared(spark, sf_dir))


@query("""
with e as (select o_orderstatus s, case when o_orderkey % 400 = 0 then 'o_custkey|o_orderstatus' when o_orderkey % 3 = 0 then 'o_custkey|o_orderpriority|o_orderstatus' else 'o_custkey|o_orderpriority|o_orderstatus|o_year' end k from orders),
sh as (select s, k, count(*) n from e group by s, k), t as (select count(*) m from e),
r as (select s, k, n, m, (n < 100 or n * 1000000 < 1000 * m) rare from sh, t),
w as (select *, case when rare then k else '' end kind from r)
select 'o_orderstatus=' || s as discr, k as keyset, cast(sum(n) over (partition by s, kind, rare) as bigint) as events,
  (sum(n) over (partition by s, kind, rare) < 100 or sum(n) over (partition by s, kind, rare) * 1000000 < 1000 * m) as is_rare from w""")
def keyset_variants(spark, sf_dir):
    """Orders with members that are sometimes absent: frequent variants merge, rare ones stay apart."""
    o = table(spark, sf_dir, "orders")
    o = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 400 != 0, F.col("o_orderpriority"))).withColumn("o_year", F.when((F.col("o_orderkey") % 400 != 0) & (F.col("o_orderkey") % 3 != 0), F.year("o_orderdate")))
    df = templates.prepared(records(o, "orders", "o_orderkey", ["o_custkey", "o_orderpriority", "o_orderstatus", "o_year"]), ("o_orderstatus",))
    return templates.kinds(templates.shapes(df)).select("discr", F.replace("keyset", F.lit("\n"), F.lit("|")).alias("keyset"), "events", "is_rare")


@query("""
with v as (select 'documents' as source, 'text' as path, text as t from documents union all select 'documents', 'lang', lang from documents union all select 'documents', 'source', source from documents
  union all select 'conversations', 'text', text from conversations union all select 'conversations', 'role', role from conversations union all select 'pages', 'url', url from pages union all select 'pages', 'html', html from pages)
select source, path, cast(count(*) as bigint) as n, cast(sum(octet_length(encode(t))) // count(*) as bigint) as avg_bytes, cast(count(*) filter (regexp_matches(t, '\\s')) * 100 // count(*) as bigint) as spaced_pct,
  (sum(octet_length(encode(t))) // count(*) >= 40 and count(*) filter (regexp_matches(t, '\\s')) * 2 >= count(*)) as is_free_text
from v where t is not null group by source, path""")
def free_text_fields(spark, sf_dir):
    out = None
    for name, key, fields in (("documents", "doc_id", ["text", "lang", "source"]), ("conversations", "conv_id", ["text", "role"]), ("pages", "page_id", ["url", "html"])):
        one = templates.free_text_fields(templates.prepared(records(table(spark, sf_dir, name), name, key, fields), ()))
        out = one if out is None else out.unionByName(one)
    return out


@query(r"""
with w as (select unnest(regexp_split_to_array(text, '\s+')) t from conversations),
c as (select t, regexp_extract(t, '(?s)^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$', 1) core from w where t <> '')
select case when regexp_matches(t, '^%[A-Za-z0-9_]+-[0-9]-[A-Za-z0-9_]+:*$') and regexp_matches(split_part(t, '-', 1), '[A-Za-z]') then t
  when regexp_matches(core, '^0[xX][0-9A-Fa-f]+$') or (regexp_matches(core, '^[0-9A-Fa-f]{8,}$') and regexp_matches(core, '[0-9]'))
  then regexp_extract(t, '(?s)^([^A-Za-z0-9]*)', 1) || '<HEX>' || regexp_extract(t, '(?s)[A-Za-z0-9]([^A-Za-z0-9]*)$', 1)
  else regexp_replace(t, '[0-9]+', '<NUM>', 'g') end as token, cast(count(*) as bigint) as n from c group by 1""")
def mask_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(masked_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


LATE = P.All((P.Test("event_type", "equals", ("error",)), P.Not(P.Test("user_id", "endswith", ("7",)))))
PLANS = {
    "view": Effective("view", drop_fields=frozenset({"props"}), forward_when=P.Test("props.k", "startswith", ("1",)), summary_keys=("user_id",)),
    "click": Effective("click", drop_fields=frozenset({"value"}), keep_whole_when=P.Test("user_id", "equals", ("7", "8"))),
    "error": Effective("error", forward_when=P.Test("props.k", "contains", ("9",)), summary_keys=("user_id", "props.k")),
}
RULES = [Rule("late-errors", LATE), Rule("any-error", P.Test("event_type", "equals", ("error",)), silent=True), Rule("purchases-of-1", P.All((P.Test("event_type", "equals", ("purchase",)), P.Test("user_id", "equals", ("1",)))))]
BURST = Correlation("error-burst", "event_count", ("any-error",), 3600, 2, ("user_id",))
FORWARDED = f"(event_type not in ('view', 'error') or (event_type = 'view' and cast({K} as varchar) like '1%') or (event_type = 'error' and cast({K} as varchar) like '%9%'))"


def applied(spark, sf_dir) -> DataFrame:
    return with_bodies(reduced(with_template(prepared(spark, sf_dir)), PLANS))


@query(f"""
select event_type as template_id, cast(floor(epoch(ts) / 60) as bigint) as minute, cast(user_id as varchar) || case when event_type = 'error' then ',' || {K} else '' end as summary_keys, cast(count(*) as bigint) as events
from events where not {FORWARDED} group by 1, 2, 3""")
def summaries_60s(spark, sf_dir):
    """Events that no rule needs, counted per minute and keys."""
    return summaries(reduced(with_template(prepared(spark, sf_dir)), PLANS)).select("template_id", "minute", F.array_join("summary_keys", ",").alias("summary_keys"), "events")


@query(f"""
select event_type, cast(count(*) as bigint) as events, cast(count(*) filter ({FORWARDED}) as bigint) as forwarded, cast(count(*) - count(*) filter ({FORWARDED}) as bigint) as summarized, cast(sum(octet_length(encode({BODY}))) as bigint) as bytes_in
from events group by rollup(event_type)""")
def rollup_volumes(spark, sf_dir):
    """Volumes per template and in total."""
    bodies = sized(applied(spark, sf_dir))
    return volumes(bodies, summaries(bodies)).select(F.col("template_id").alias("event_type"), "events", "forwarded", "summarized", "bytes_in")


OUT_BODY = f"""case when event_type = 'view' then '{{"event_type":"view","user_id":' || user_id || ',"value":"' || {VALUE} || '"}}'
  when event_type = 'click' and user_id not in (7, 8) then '{{"event_type":"click","props.k":' || {K} || ',"user_id":' || user_id || '}}' else {BODY} end"""


@query(f"select event_id, {OUT_BODY} as out_body from events where {FORWARDED}")
def reduce_forward_bodies(spark, sf_dir):
    """What is forwarded."""
    return applied(spark, sf_dir).where("route = 'forward'").select("event_id", "out_body")


@query(f"""
select event_type as template_id, 'props.k' as path, cast(count(*) as bigint) as events, cast(sum(5 + length(cast({K} as varchar))) as bigint) as bytes from events where event_type = 'view' and {FORWARDED} group by 1
union all select event_type, 'value', count(*), cast(sum(9 + length('"' || {VALUE} || '"')) as bigint) from events where event_type = 'click' and user_id not in (7, 8) group by 1""")
def removed_bytes_by_field(spark, sf_dir):
    return removals(applied(spark, sf_dir))


@query("select 'late-errors' as rule, event_id from events where event_type = 'error' and cast(user_id as varchar) not like '%7' union all select 'purchases-of-1', event_id from events where event_type = 'purchase' and user_id = 1")
def sigma_selection(spark, sf_dir):
    """Selections with an exclusion."""
    return alerts(prepared(spark, sf_dir), RULES, [], [EVENTS])


WORDS = ("license", "gnu general", "password", "scum")


@query("select 'words' as rule, doc_id as event_id from documents where " + " or ".join(f"lower(text) like '%{w}%'" for w in WORDS))
def sigma_keywords(spark, sf_dir):
    """Documents that hold any of some words, whatever their case."""
    docs = templates.prepared(records(table(spark, sf_dir, "documents"), "documents", "doc_id", ["text"]), ()).withColumn("ts", F.lit(None).cast("timestamp"))
    return alerts(docs, [Rule("words", P.Words(WORDS))], [], [Source("documents")])


COUNTED = """select '{rule}' as rule, a.event_id from events a join events b on a.user_id = b.user_id and {base} and cast(floor(epoch(b.ts)) as bigint) >= cast(floor(epoch(a.ts)) as bigint) - {span}
  and (cast(floor(epoch(b.ts)) as bigint) < cast(floor(epoch(a.ts)) as bigint) or (cast(floor(epoch(b.ts)) as bigint) = cast(floor(epoch(a.ts)) as bigint) and b.event_id <= a.event_id)) group by a.event_id having {test}"""


@query(COUNTED.format(rule="error-burst", base="a.event_type = 'error' and b.event_type = 'error'", span=3600, test="count(*) >= 2"))
def correlation_event_count(spark, sf_dir):
    """Two errors of a user within an hour."""
    return alerts(prepared(spark, sf_dir), RULES, [BURST], [EVENTS]).where("rule = 'error-burst'")


@query(COUNTED.format(rule="many-kinds", base="true", span=7200, test="count(distinct b.event_type) >= 2"))
def correlation_value_count(spark, sf_dir):
    """Different kinds of events of a user within two hours."""
    rule = Rule("any", P.present("event_type"), silent=True)
    return alerts(prepared(spark, sf_dir), [rule], [Correlation("many-kinds", "value_count", ("any",), 7200, 2, ("user_id",), "event_type")], [EVENTS])


@query(f"""
with f as (select * from events where {FORWARDED}),
full_a as ({ORACLE_SQL['sigma_selection']} union all {ORACLE_SQL['correlation_event_count']}),
fwd_a as ({ORACLE_SQL['sigma_selection'].replace('from events', 'from f')} union all {ORACLE_SQL['correlation_event_count'].replace('events a', 'f a').replace('events b', 'f b')})
select rule, event_id, 'missing' as change from (select * from full_a except select * from fwd_a) union all select rule, event_id, 'extra' from (select * from fwd_a except select * from full_a)""")
def proof_missing_extra(spark, sf_dir):
    """What an unsafe plan would do to the alerts."""
    df = proof.flattened_once(with_template(prepared(spark, sf_dir)))
    ask = lambda events: alerts(events, RULES, [BURST], [EVENTS])
    return proof.compared(ask(df), ask(proof.forwarded_events(reduced(df, PLANS))))


def people(spark, sf_dir) -> DataFrame:
    """Customers with their nation and region: fields that imply each other."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("kind", F.lit("customer"))
    return templates.prepared(records(c, "customers", "c_custkey", ["nation", "region", "kind"]), ()).withColumn("template_id", F.col("source"))


PEOPLE = "with c as (select c_custkey id, n_name nation, r_name region, 'customer' kind from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey), l as (select id, 'nation' as field, '\"' || nation || '\"' as v from c union all select id, 'region', '\"' || region || '\"' from c union all select id, 'kind', '\"customer\"' from c)"


def mined(spark, sf_dir):
    df = people(spark, sf_dir)
    leaves, mid = implied.long_form(df), implied.middles(df)
    return leaves, implied.columns(leaves, mid.select("template_id", "n")), mid


@query(PEOPLE + """, n as (select field, v, count(*) k from l group by 1, 2), t as (select field, sum(k) total, max(k) held from n group by 1)
select t.field, min(v) as value, cast(held as bigint) as held, cast(total as bigint) as total from t join n on n.field = t.field and k = held where held * 10 >= total * 9 group by 1, 3, 4""")
def implied_constants(spark, sf_dir):
    """Values that the kind of event says."""
    leaves, candidates, _ = mined(spark, sf_dir)
    return implied.constants(leaves, candidates).select("field", "value", "held", "total")


@query(PEOPLE + """, m as (select id as middle from (select id, row_number() over (order by id) - 1 p, count(*) over () n from c) where p = n // 2),
s as (select field, v, min(id) first_seen from l group by 1, 2) select field, cast(count(*) as bigint) as "values" from s, m group by field, middle having count(*) between 2 and 32 and max(first_seen) < middle""")
def closed_category(spark, sf_dir):
    leaves, candidates, mid = mined(spark, sf_dir)
    return implied.closed_categories(leaves, candidates, mid.select("template_id", "middle")).select("field", "values")


@query(PEOPLE + """, m as (select id as middle from (select id, row_number() over (order by id) - 1 p, count(*) over () n from c) where p = n // 2),
s as (select field, v, min(id) first_seen from l group by 1, 2), closed as (select field from s, m group by field, middle having count(*) between 2 and 32 and max(first_seen) < middle),
p as (select a.field when_field, a.v when_value, b.field, b.v, count(*) k from l a join closed using (field) join l b on a.id = b.id and a.field <> b.field group by 1, 2, 3, 4),
t as (select when_field, when_value, field, sum(k) total, max(k) held from p group by 1, 2, 3)
select t.when_field, t.when_value, t.field, min(p.v) as value, cast(held as bigint) as held, cast(total as bigint) as total from t join p on p.when_field = t.when_field and p.when_value = t.when_value and p.field = t.field and k = held
where total >= 20 and held * 10 >= total * 9 group by 1, 2, 3, 5, 6""")
def implied_by_field(spark, sf_dir):
    """Values that another field says: the nation its region."""
    leaves, candidates, mid = mined(spark, sf_dir)
    closed = implied.closed_categories(leaves, candidates, mid.select("template_id", "middle"))
    return implied.implied_by_field(leaves, candidates, closed).select("when_field", "when_value", "field", "value", "held", "total")


@query("select 'customers' as template_id, cast(count(*) as bigint) as events, cast(0 as bigint) as mismatches, cast(count(*) as bigint) as shorter from customer")
def rebuild_roundtrip(spark, sf_dir):
    """Implied values left out and put back: every body as before."""
    df = people(spark, sf_dir)
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").orderBy("n_name").collect()  # 25 rows: a dimension
    values = [Implied("kind", '"customer"'), *(Implied("region", f'"{r}"', ("nation", f'"{n}"')) for n, r in places)]
    plan = {"customers": Effective("customers", implied=tuple(values))}
    back = rebuild(reduced(df, plan), plan)
    same = F.array_sort(F.map_entries("restored")) == F.array_sort(F.map_entries("leaves"))
    return back.groupBy("template_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(~same).alias("mismatches"), F.count_if(F.size("kept") < F.size("leaves")).alias("shorter"))


@query("""select coalesce(a.n_name, b.n_name) as rule, case when a.n_name is null then 'added' when b.n_name is null then 'removed' else 'changed' end as change
from (select n_name, n_regionkey k from nation where n_nationkey < 20) a full join (select n_name, case when n_nationkey % 5 = 0 then 9 else n_regionkey end k from nation where n_nationkey >= 3) b on a.n_name = b.n_name
where a.n_name is null or b.n_name is null or a.k <> b.k""")
def rule_changes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    print_of = lambda k: F.sha2(F.concat_ws("\x00", "n_name", k.cast("string")), 256)
    then = n.where("n_nationkey < 20").select(F.col("n_name").alias("rule"), print_of(F.col("n_regionkey")).alias("fingerprint"))
    now = n.where("n_nationkey >= 3").select(F.col("n_name").alias("rule"), print_of(F.when(F.col("n_nationkey") % 5 == 0, 9).otherwise(F.col("n_regionkey"))).alias("fingerprint"))
    return verify.rule_changes(then, now)


@query("""with h as (select event_type, event_id < (select (min(event_id) + max(event_id)) // 2 from events) early, value from events),
v as (select event_type, early, round(100.0 * (sum(cast(value * 100 as bigint)) - sum(case when early then 0 else cast(value * 100 as bigint) end)) / sum(cast(value * 100 as bigint)), 1) p from h group by 1, 2)
select a.event_type as template, a.p as before, b.p as after, round(a.p - b.p, 1) as lost from v a join v b on a.event_type = b.event_type and a.early and not b.early where round(a.p - b.p, 1) >= 10""")
def drift(spark, sf_dir):
    """A plan that saved all of the earlier half and nothing of the later."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    e = e.select(F.col("event_type").alias("template"), (F.col("event_id") < (lo + hi) // 2).alias("early"), F.round(F.col("value") * 100).cast("long").alias("bytes_in")).withColumn("bytes_out", F.when(F.col("early"), 0).otherwise(F.col("bytes_in")))
    v = verify.saved_pct(e.groupBy("template", "early").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")))
    return verify.drift(v.where("early"), v.where("not early"))


@query("select r as rule from (values ('error'), ('purchase'), ('logout-storm'), ('teleport')) v(r) where r not in (select event_type from events)")
def coverage_gaps(spark, sf_dir):
    """Rules that no template can feed."""
    from quietlog.model import Template
    from quietlog.operators.guard import Requirement
    from quietlog.operators.guard import coverage_gaps as gaps

    kinds = template_volumes(spark, sf_dir).collect()  # templates, not events
    known = [Template(t.discr, t.source, EVENTS.logsource, discriminators=(tuple(t.discr.split("=", 1)),), variants=(("event_type", "props.k", "user_id", "value"),), events=t.events) for t in kinds]
    rules = [Requirement(r, LogSource(), None, frozenset({"event_type"}), prefilter=P.Test("event_type", "equals", (r,))) for r in ("error", "purchase", "logout-storm", "teleport")]
    return spark.createDataFrame([(r,) for r in gaps(rules, known)], "rule string")


@query(f"select event_type as template_id, route, event_id from (select event_type, event_id, case when {FORWARDED} then 'forward' else 'summarize' end as route, row_number() over (partition by event_type, {FORWARDED} order by event_id) as k from events) where k <= 5")
def first_k_per_template(spark, sf_dir):
    return proof.spot_checks(reduced(with_template(prepared(spark, sf_dir)), PLANS)).select("template_id", "route", "event_id")


@query(PEOPLE + """, n as (select field, v, count(*) k from l group by 1, 2), t as (select field, sum(k) total, max(k) held from n group by 1),
b as (select t.field, min(v) v, held, total from t join n on n.field = t.field and k = held group by 1, 3, 4), p as (select unnest([100, 99, 95, 90, 50]) as percent)
select percent, cast(sum(held * (length(field) + 4 + octet_length(encode(v)))) as bigint) as bytes, cast(count(*) as bigint) as fields from b, p where held * 100 >= total * percent group by 1""")
def determinism(spark, sf_dir):
    """Bytes that the kind of event says, by how surely."""
    counts = implied.long_form(people(spark, sf_dir)).groupBy("template_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return accounting.determinism(counts)


@query()
def drain_templates(spark, sf_dir):
    """Templates of all lines that conversations hold."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    lines = c.select(F.lit("conversations").alias("source"), F.expr("conv_id * 1000000000 + turn * 100000 + at").alias("event_id"), "text")
    return text_templates(lines).groupBy("template_id", "header", F.array_join("pattern", " ").alias("pattern")).agg(F.count(F.lit(1)).alias("lines"))


@query(ORACLE_SQL["summaries_60s"])
def stream_summaries(spark, sf_dir):
    """The same summaries from a stream that reads the table to its end."""
    from quietlog.streaming.pipeline import summaries_of_stream

    def shaped(batch: DataFrame) -> DataFrame:
        text = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"user_id":'), "user_id", F.lit(',"value":"'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit('"}'))
        rows = batch.select("event_id", "ts", F.lit("events").alias("source"), body(text).alias("body"))
        return reduced(with_template(templates.prepared(rows, ("event_type",))), PLANS)

    found = summaries_of_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, shaped)
    return found.select("template_id", "minute", F.array_join("summary_keys", ",").alias("summary_keys"), "events")


from quietlog import rule_queries  # noqa: E402 - registers its queries with those above

__all__ = ["ORACLE_SQL", "QUERIES", "rule_queries"]
