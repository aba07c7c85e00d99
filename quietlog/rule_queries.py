"""More of the engine on the driver's tables: rule languages read and applied, discovery inside the data pass, guard, plans and their verification, each with SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions import predicate as P
from quietlog.functions.text import masked_tokens
from quietlog.model import Effective, LogSource, Source, Template
from quietlog.operators import accounting, implied, proof, templates
from quietlog.operators.alerts import alerts, numbered_rows
from quietlog.operators.drain import text_templates
from quietlog.operators.guard import Requirement, guard
from quietlog.operators.reduce import reduced, sized, summaries, volumes, with_bodies
from quietlog.plans import recipes, verify
from quietlog.queries import BODY, BURST, EVENTS, FORWARDED, ORACLE_SQL, OUT_BODY, PLANS, RULES, K, applied, mined, prepared, query, spread, table, with_template
from quietlog.rules import kibana, kusto, sigma, spl, wazuh
from quietlog.store import written

VALUE = "cast(cast(value as decimal(18,2)) as varchar)"
USER = "cast(user_id as varchar)"


def passing(spark, sf_dir, p: P.Predicate) -> DataFrame:
    """event_id of the events that a pre-filter lets through."""
    return prepared(spark, sf_dir).where(P.compiled(p)).select("event_id")


def prepared_once(spark, sf_dir) -> DataFrame:
    """prepared() written once: discovery and what follows it both go over the events."""
    return written(prepared(spark, sf_dir), "prepared")


@query(f"select event_id from events where (event_type like '%error%' or event_type like '%pur%') and {USER} like '%7%'")
def rule_kibana_kql(spark, sf_dir):
    """A Kibana query's bound: values may be analysed, so they are sought anywhere in the field."""
    return passing(spark, sf_dir, kibana.kql("event_type: (error or pur*) and user_id: 7* and props.k: *").prefilter)


@query(f"select event_id from events where event_type in ('error', 'click') and {VALUE} like '%5' and {USER} like '1%'")
def rule_eql(spark, sf_dir):
    return passing(spark, sf_dir, kibana.eql('any where event_type in ("error", "click") and endsWith(value, "5") and user_id like "1*"').prefilter)


@query("select event_id from events where event_type = 'view' and user_id in (7, 8)")
def rule_esql(spark, sf_dir):
    return passing(spark, sf_dir, kibana.esql('from logs | where event_type == "view" and user_id in ("7", "8") | keep event_type').prefilter)


@query(f"select event_id from events where event_type = 'error' and ({USER} like '1%' or {USER} like '2%')")
def rule_spl(spark, sf_dir):
    """A search's bound: what NOT and later commands say only narrows it."""
    return passing(spark, sf_dir, spl.spl("index=main event_type=error (user_id=1* OR user_id=2*) NOT value=3* | where len(value) > 3").prefilter)


@query(f"select event_id from events where event_type = 'error' and {USER} like '3%'")
def rule_spl_macro(spark, sf_dir):
    return passing(spark, sf_dir, spl.spl("`of(error)` user_id=3*", {"of(1)": (["t"], "event_type=$t$")}).prefilter)


@query(f"select event_id from events where event_type in ('error', 'view') and {VALUE} like '1%'")
def rule_kusto(spark, sf_dir):
    return passing(spark, sf_dir, kusto.kusto('Events | where event_type in ("error", "view") and value startswith "1" and props_k != 3')[0].prefilter)


CHAIN = '<group name="shop,"><rule id="900" level="2"><field name="event_type">error</field></rule><rule id="901" level="7"><if_sid>900</if_sid><field name="user_id">^4</field></rule></group>'


@query("select r as rule, event_id from events, (values ('900'), ('901')) v(r)")
def rule_wazuh_chain(spark, sf_dir):
    """Chained rules bound by what their parents need: a pattern on a field asks for the field."""
    out = None
    for r in wazuh.load([CHAIN])[0]:
        one = passing(spark, sf_dir, r.prefilter).select(F.lit(r.rule).alias("rule"), "event_id")
        out = one if out is None else out.unionByName(one)
    return out


SIGMA = """
id: mixed
logsource: {product: shop}
detection:
  kind: {event_type|re: '^(error|view)$'}
  who: {user_id|startswith: ['1', '2']}
  cents: {value|endswith: '.5?'}
  any: {props.k|contains: '7'}
  condition: kind and (who or 1 of an*) and not cents
---
id: elsewhere
logsource: {product: windows}
detection: {sel: {event_type: error}, condition: sel}
---
id: failing
name: failing
logsource: {product: shop}
detection: {sel: {event_type: error}, condition: sel}
---
id: buying
name: buying
logsource: {product: shop}
detection: {sel: {event_type: purchase}, condition: sel}
---
id: both
correlation: {type: temporal, rules: [failing, buying], group-by: [user_id], timespan: 2h}
---
id: first-failing
correlation: {type: temporal_ordered, rules: [failing, buying], group-by: [user_id], timespan: 2h}
---
id: few
correlation: {type: event_count, rules: failing, group-by: [user_id], timespan: 1d, condition: {lt: 2}}
"""
S = "cast(floor(epoch({0}.ts)) as bigint)"
PAIR = f"a.user_id = b.user_id and {S.format('b')} >= {S.format('a')} - 7200 and ({S.format('b')} < {S.format('a')} or ({S.format('b')} = {S.format('a')} and b.event_id <= a.event_id))"


def fired(spark, sf_dir, name: str) -> DataFrame:
    loaded = sigma.load([SIGMA])
    wanted = [c for c in loaded.correlations if c.id == name]
    return alerts(prepared(spark, sf_dir), loaded.rules, wanted, [EVENTS]).where(F.col("rule") == name)


@query(f"select 'mixed' as rule, event_id from events where event_type in ('error', 'view') and ({USER} like '1%' or {USER} like '2%' or cast({K} as varchar) like '%7%') and not {VALUE} like '%.5_'")
def rule_sigma_modifiers(spark, sf_dir):
    """Regular expressions, lists, wildcards, a quantifier and a negation, evaluated exactly; rules for other products see nothing."""
    loaded = sigma.load([SIGMA])
    return alerts(prepared(spark, sf_dir), [r for r in loaded.rules if r.id in ("mixed", "elsewhere")], [], [EVENTS])


@query(f"select distinct 'both' as rule, a.event_id from events a join events b on a.event_type in ('error', 'purchase') and b.event_type in ('error', 'purchase') and b.event_type <> a.event_type and {PAIR}")
def correlation_temporal(spark, sf_dir):
    """Two rules within a span of each other, in any order."""
    return fired(spark, sf_dir, "both")


@query(f"select distinct 'first-failing' as rule, a.event_id from events a join events b on a.event_type = 'purchase' and b.event_type = 'error' and {PAIR}")
def correlation_temporal_ordered(spark, sf_dir):
    return fired(spark, sf_dir, "first-failing")


@query(f"select 'few' as rule, a.event_id from events a join events b on a.event_type = 'error' and b.event_type = 'error' and {PAIR.replace('7200', '86400')} group by a.event_id having count(*) < 2")
def correlation_less_than(spark, sf_dir):
    return fired(spark, sf_dir, "few")


@query("select event_id, 'event_type=' || event_type as discr from events")
def assigned_events(spark, sf_dir):
    """Discovery and assignment: every event with the template its shape belongs to."""
    df = prepared_once(spark, sf_dir)
    kinds = templates.kinds_of(df)
    names = kinds.select("template_id", F.col("discr").alias("of_template")).distinct()
    return templates.assigned(df, kinds).select("event_id", "template_id").join(names, "template_id").select("event_id", F.col("of_template").alias("discr"))


def discovered_plans(spark, sf_dir):
    """(events with discovered templates, plans of discovered templates): what PLANS says, by template instead of event type."""
    df = prepared_once(spark, sf_dir)
    kinds = templates.kinds_of(df)
    names = {r.discr.partition("=")[2]: r.template_id for r in kinds.select("discr", "template_id").distinct().collect()}  # templates, not events
    plans = {names[t]: Effective(names[t], p.drop_fields, p.empty_except, p.implied, p.keep_whole_when, p.forward_when, p.summary_keys) for t, p in PLANS.items() if t in names}
    return templates.assigned(df, kinds), plans


@query(ORACLE_SQL["reduce_forward_bodies"])
def discovered_forward_bodies(spark, sf_dir):
    """What is forwarded, with templates discovered and assigned in the query itself."""
    df, plans = discovered_plans(spark, sf_dir)
    return with_bodies(reduced(df, plans)).where("route = 'forward'").select("event_id", "out_body")


KNOWN = [Template(f"t-{t}", "events", EVENTS.logsource, discriminators=(("event_type", t),), variants=(("event_type", "props.k", "user_id", "value"),)) for t in ("view", "error", "gone")]


@query("select event_id, case when event_type in ('view', 'error') then 't-' || event_type end as template_id from events")
def classified_events(spark, sf_dir):
    """Known templates applied to events: a hash join on the shape; what fits none has no template."""
    return templates.classified(prepared(spark, sf_dir), KNOWN, [EVENTS]).select("event_id", "template_id")


@query("select 'events' as source, cast(count(*) as bigint) as events, cast(count(*) filter (event_type not in ('view', 'error')) as bigint) as unknown, round(100.0 * count(*) filter (event_type not in ('view', 'error')) / count(*), 1) as unknown_pct from events having count(*) > 0")
def unknown_share(spark, sf_dir):
    return verify.unknown_share(templates.classified(prepared(spark, sf_dir), KNOWN, [EVENTS]))


@query("select 't-' || t as template from (values ('view'), ('error'), ('gone')) v(t) where t not in (select event_type from events)")
def absent_templates(spark, sf_dir):
    recorded = spark.createDataFrame([(t.id,) for t in KNOWN], "template string")
    seen = templates.classified(prepared(spark, sf_dir), KNOWN, [EVENTS]).where("template_id is not null").select(F.col("template_id").alias("template")).distinct()
    return verify.absent(recorded, seen)


def order_lines(spark, sf_dir) -> DataFrame:
    """Orders as lines of text, those with odd keys behind a syslog header."""
    line = F.concat(F.lit("order "), "o_orderkey", F.lit(" of customer "), "o_custkey", F.lit(" is "), "o_orderstatus")
    head = F.concat(F.lit("<13>Jan  2 03:04:05 host-1 shop["), F.col("o_orderkey") % 97, F.lit("]: "))
    odd = F.col("o_orderkey") % 2 == 1
    return spread(table(spark, sf_dir, "orders")).select(F.lit("orders").alias("source"), F.col("o_orderkey").cast("long").alias("event_id"), F.when(odd, F.concat(head, line)).otherwise(line).alias("text"))


@query("""select case when o_orderkey % 2 = 1 then 'shop order <NUM> of customer <NUM> is ' else 'order <NUM> of customer <NUM> is ' end || o_orderstatus as pattern,
  case when o_orderkey % 2 = 1 then 'syslog' else 'none' end as header, cast(count(*) as bigint) as lines from orders group by 1, 2""")
def text_templates_of_orders(spark, sf_dir):
    """Drain on lines whose last word has few values, so that each makes a template of its own; the program's name of a header leads."""
    return text_templates(order_lines(spark, sf_dir)).groupBy(F.array_join("pattern", " ").alias("pattern"), "header").agg(F.count(F.lit(1)).alias("lines"))


@query("""select o_orderkey as event_id, case when o_orderkey % 2 = 1 then null when o_orderstatus in ('F', 'O') then 'order-' || o_orderstatus end as template_id from orders""")
def classified_lines(spark, sf_dir):
    """Known text templates applied to lines; a line with a header fits no pattern that was learnt without."""
    source = Source("orders", text_field="line")
    known = [Template(f"order-{s}", "orders", pattern=("order", "<NUM>", "of", "customer", "<NUM>", "is", s), header="none", text_fields=("line",)) for s in ("F", "O")]
    rows = order_lines(spark, sf_dir).select("event_id", "source", F.lit(None).cast("timestamp").alias("ts"), F.parse_json(F.to_json(F.struct(F.col("text").alias("line")))).alias("body"))
    return templates.classified(templates.prepared(rows, ()), known, [source]).select("event_id", "template_id")


@query(f"""with l as (select event_type t, unnest(json_keys({BODY})) as k, {BODY} as b from events),
f as (select case when k = 'props' then 'props.k' else k end as path, case when k = 'props' then json_type(b, '$.props.k') else json_type(b, '$.' || k) end as j from l)
select path, replace(path, '.', '_') as name, case when bool_and(j in ('UBIGINT', 'BIGINT')) then 'long' when bool_and(j = 'DOUBLE') then 'real' when bool_and(j = 'BOOLEAN') then 'boolean' else 'string' end as type from f group by path""")
def custom_table(spark, sf_dir):
    """The table that the events would need."""
    return accounting.inferred_columns(prepared(spark, sf_dir))


@query(f"""with changed as ({ORACLE_SQL['proof_missing_extra']}), kinds as (select distinct event_type t from events where event_type in ('view', 'click', 'error'))
select v.t as template, v.t not in (select e.event_type from changed c join events e on e.event_id = c.event_id) as still_reduces from (values ('view'), ('click'), ('error')) v(t)""")
def proof_rollback(spark, sf_dir):
    """The same plan after rolling back what changed an alert."""
    df = with_template(prepared(spark, sf_dir))
    found = proof.select_proven(df, PLANS, lambda events: alerts(events, RULES, [BURST], [EVENTS]))
    return spark.createDataFrame([(t, p.reduces()) for t, p in found.plans.items()], "template string, still_reduces boolean")


#: Bytes of a summary record, and volumes of templates under PLANS.
RECORDS = f"""s as (select * from ({ORACLE_SQL['summaries_60s']})), sb as (select template_id t, sum(octet_length(encode('{{"template_id":"' || template_id || '","minute":' || minute || ',"summary_keys":["' || replace(summary_keys, ',', '","') || '"],"events":' || events || '}}'))) b from s group by 1),
v as (select event_type t, sum(octet_length(encode({BODY}))) bytes_in, sum(case when {FORWARDED} then octet_length(encode({OUT_BODY})) else 0 end) bytes_out from events group by 1),
w as (select v.t, cast(bytes_in as bigint) bytes_in, cast(bytes_out + coalesce(sb.b, 0) as bigint) bytes_out from v left join sb on sb.t = v.t),
r as (select template_id t, sum(bytes) b from ({ORACLE_SQL['removed_bytes_by_field']}) group by 1)"""


@query(f"with {RECORDS} select t as template_id, bytes_in, bytes_out from w")
def bytes_by_template(spark, sf_dir):
    """Bytes before and after, summaries counted."""
    bodies = sized(applied(spark, sf_dir))
    return volumes(bodies, summaries(bodies)).where("template_id is not null").select("template_id", "bytes_in", "bytes_out")


@query(f"""with {RECORDS}, x as (select w.t, greatest(0, bytes_in - bytes_out) total, case when w.t = 'click' then coalesce(r.b, 0) else 0 end by_implied, case when w.t = 'click' then 0 else coalesce(r.b, 0) end by_fields from w left join r on r.t = w.t),
y as (select *, least(by_implied, total) im from x), z as (select *, least(by_fields, total - im) du from y)
select t as template_id, cast(total as bigint) as total, cast(du as bigint) as duplicates, cast(im as bigint) as implied, cast(total - im - du as bigint) as counts from z""")
def saved_by_mode(spark, sf_dir):
    """Savings by mode; the clicks' value stands for an implied one."""
    bodies = sized(applied(spark, sf_dir))
    return accounting.saved_by_mode(bodies, volumes(bodies, summaries(bodies)), {"click": ["value"]})


@query(f"""with {RECORDS}, g as (select sum(bytes_in) / 1e9 * 30 a, sum(bytes_out) / 1e9 * 30 b from w)
select arrangement, round(case arrangement when 'everything' then a * 4.3 when 'reduced' then b * 4.3 when 'reduced_and_lake' then b * 4.3 + a * 0.15 else b * 4.3 + (a - b) * 0.15 end, 6) as cost
from g, (values ('everything'), ('reduced'), ('reduced_and_lake'), ('routed_and_lake')) v(arrangement)""")
def tier_costs(spark, sf_dir):
    bodies = sized(applied(spark, sf_dir))
    return accounting.tier_costs(volumes(bodies, summaries(bodies)))


@query(f"""with c as ({ORACLE_SQL['implied_constants']}), f as ({ORACLE_SQL['implied_by_field']}),
best as (select when_field, field, sum(held * (length(field) + 4 + octet_length(encode(value)))) s, row_number() over (partition by field order by sum(held * (length(field) + 4 + octet_length(encode(value)))) desc, when_field) p from f group by 1, 2)
select 'customers' as template_id, field, value, cast(null as varchar) as when_field, cast(null as varchar) as when_value, cast(held * (length(field) + 4 + octet_length(encode(value))) as bigint) as saved from c
union all select 'customers', f.field, f.value, f.when_field, f.when_value, cast(held * (length(f.field) + 4 + octet_length(encode(f.value))) as bigint) from f join best b on b.field = f.field and b.when_field = f.when_field and p = 1
where f.field not in (select field from c) and f.when_field not in (select field from c)""")
def implied_chosen(spark, sf_dir):
    """The values to leave out: largest savings first, no field that implies another."""
    leaves, candidates, mid = mined(spark, sf_dir)
    alone = implied.constants(leaves, candidates)
    closed = implied.closed_categories(leaves, candidates, mid.select("template_id", "middle"))
    return implied.chosen(alone, implied.implied_by_field(leaves, candidates, closed))


BOOK = "id: views\nlogsource: {product: shop}\nmatch: {fields: {event_type: view}}\nforward_matching: {keys: [user_id]}\n---\nid: clicks\nlogsource: {product: shop}\nmatch: {fields: {event_type: click}}\ndrop_fields: [props, value]\n"
NEEDS = [
    Requirement("user-7", LogSource("shop"), None, frozenset({"user_id"}), prefilter=P.Test("user_id", "equals", ("7",))),
    Requirement("cheap-clicks", LogSource("shop"), None, frozenset({"value"}), prefilter=P.All((P.Test("event_type", "equals", ("click",)), P.Test("value", "startswith", ("1",))))),
]


@query(f"""select event_id, case when event_type = 'click' and not {VALUE} like '1%' then '{{"event_type":"click","user_id":' || user_id || '}}' else {BODY} end as out_body from events where event_type <> 'view' or user_id = 7""")
def guarded_forward_bodies(spark, sf_dir):
    """From discovery over recipes and the guard to what is forwarded: views that rule user-7 can match, and clicks whole where rule cheap-clicks may match, else without the fields the recipe names."""
    df = prepared_once(spark, sf_dir)
    kinds = templates.kinds_of(df)
    rows = kinds.groupBy("template_id", "discr", "events", "bytes", "source_events").agg(F.collect_list("keyset").alias("keysets")).collect()  # templates, not events
    known = [Template(r.template_id, "events", EVENTS.logsource, discriminators=(tuple(r.discr.split("=", 1)),), variants=tuple(tuple(k.split("\n")) for k in r.keysets), events=r.events, bytes=r.bytes, source_events=r.source_events) for r in rows]
    found, _ = recipes.resolve(recipes.book([BOOK]), known)
    plans = {t.id: guard(t, found.get(t.id), NEEDS) for t in known}
    return with_bodies(reduced(templates.assigned(df, kinds), plans)).where("route = 'forward'").select("event_id", "out_body")


@query("select event_type as template, cast(rank() over (order by count(*) desc, event_type) as int) as place, cast(count(*) as bigint) as events from events group by event_type order by count(*) desc, event_type limit 3")
def top_templates(spark, sf_dir):
    """The report of the largest templates; its length is the feature."""
    df = with_template(prepared(spark, sf_dir)).groupBy(F.col("template_id").alias("template")).agg(F.count(F.lit(1)).alias("events"))
    top = df.orderBy(F.desc("events"), "template").limit(3)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("events"), "template"))).select("template", "place", "events")


@query(f"""with x as (select event_type t, {FORWARDED} fwd, event_id, row_number() over (partition by event_type, {FORWARDED} order by event_id) k from events), y as (select *, row_number() over (order by k, t, fwd) n from x where k <= 10)
select t as template_id, case when fwd then 'forward' else 'summarize' end as route, event_id from y where n <= 10""")
def examples_in_turn(spark, sf_dir):
    """Ten examples, one of each template and outcome in turn; their number is the feature."""
    return proof.examples(reduced(with_template(prepared(spark, sf_dir)), PLANS), 10).select("template_id", "route", "event_id")


@query(f"""select event_type as template_id, case when {FORWARDED} then 'forward' else 'summarize' end as route, case when event_type = 'click' then user_id in (7, 8) when event_type = 'view' then false else true end as whole, cast(min(event_id) as bigint) as event_id from events group by 1, 2, 3""")
def regression_fixtures(spark, sf_dir):
    """One event for each template, outcome and whether it stays whole: what a deployed plan is tested with."""
    return proof.fixtures(reduced(with_template(prepared(spark, sf_dir)), PLANS)).select("template_id", "route", "whole", "event_id")


@query("select n_regionkey as rule, n_regionkey as k, cast(row_number() over (partition by n_regionkey) as int) as occurrence from nation")
def alert_occurrences(spark, sf_dir):
    """Equal rows of a rule stay alerts of their own."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("rule"), F.col("n_regionkey").alias("k"))
    return numbered_rows(n, "rule", ["k"])


@query("select 'set-' || (n_regionkey % 2) as set, cast(count(distinct n_regionkey) as bigint) as rules from nation group by 1")
def rules_per_set(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return verify.rules_per_set(n.select(F.concat(F.lit("set-"), F.col("n_regionkey") % 2).alias("set"), F.col("n_regionkey").alias("rule")))


@query("select event_id, user_id in (7, 8) or event_type in ('error', 'purchase') as kept from events")
def predicate_alternatives(spark, sf_dir):
    """Alternatives merged into tests of many values, and a field that must be there."""
    p = P.any_of([P.Test("user_id", "equals", ("7",)), P.Test("user_id", "equals", ("8",)), P.any_of([P.Test("event_type", "equals", ("error",)), P.Test("event_type", "equals", ("PURCHASE",))]), P.all_of([P.present("nothing"), P.present("value")])])
    return prepared(spark, sf_dir).select("event_id", P.compiled(p).alias("kept"))


@query(f"select event_id, {USER} like '1%' or {USER} like '2%' or {USER} like '3%' or {USER} like '45%' or {USER} like '99%' or {USER} like '7%' as kept from events")
def predicate_many_values(spark, sf_dir):
    """Many values of one test become one pattern."""
    return prepared(spark, sf_dir).select("event_id", P.compiled(P.Test("user_id", "startswith", ("1", "2", "3", "45", "99", "7"))).alias("kept"))


@query("select distinct word from (select unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) as word from conversations) where regexp_full_match(word, '[a-z]+')")
def unmasked_words(spark, sf_dir):
    """Words without a digit pass the masks unchanged."""
    words = table(spark, sf_dir, "conversations").select(F.explode(masked_tokens("lower(text)")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$")).distinct()
