"""Registered queries of the language, each with the DuckDB SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.domain import attack, indicators
from sluice.engine import Engine
from sluice.sources.catalog import Bounded
from sluice.sources.schema import Base, Knowledge, Schema, engagements
from sluice.sources.tables import ROLLUP_BEFORE, catalog, epoch, schema

#: Events as the language sees them; k is the bag's only key.
EV = "(SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type, value, props, json_extract_string(props, '$.k') AS k FROM events)"
METRIC = f"""(SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS host, event_type AS name, props AS labels, value, user_id FROM events WHERE epoch(ts) >= {ROLLUP_BEFORE}
 UNION ALL SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600, CAST(user_id AS VARCHAR), event_type, props, avg(value), user_id FROM events WHERE epoch(ts) < {ROLLUP_BEFORE} GROUP BY ALL)"""
COLS = "event_id, ts, user_id, event_type, value, props"

KNOWLEDGE = Knowledge(
    aliases={"kind_of": "event_type"},
    calculated=(("double_value", "value * 2"),),
    eventtypes={"bought": "event_type=purchase value>=50"},
    tags={"seen": (("event_type", "view"), ("event_type", "click"))},
    macros={"of": (("what",), "event_type=$what$")},
    lookups=(("nation", "user_id", ("n_name",)),),
)


def _rounded(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Sums of doubles differ in their last bits by the order of addition."""
    return lambda df: df.withColumns({c: F.round(c, 4) for c in columns})


#: Bounds in seconds, not on an hour; the second one is in the rolled-up half.
FROM, UNTIL = 1_704_900_123, 1_705_900_321
IN_TIME = f"ts BETWEEN {FROM} AND {UNTIL}"

#: name: (query, SQL[, schema change[, result change[, bounds]]])
QUERIES: dict[str, tuple] = {
    "flt_eq": ("search event_type=click | table event_id,user_id", "SELECT event_id, user_id FROM events WHERE event_type = 'click'"),
    "flt_colon": ("event_type:click | stats count", "SELECT count(*) AS count FROM events WHERE event_type = 'click'"),
    "flt_ne": ("search event_type!=click | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type <> 'click' GROUP BY 1"),
    "flt_num": ("search value>=50 | stats count", "SELECT count(*) AS count FROM events WHERE value >= 50"),
    "flt_spaced": ("search value < 20.5 event_type = view | stats count", "SELECT count(*) AS count FROM events WHERE value < 20.5 AND event_type = 'view'"),
    "flt_json_num": ("search k>50 | stats count by event_type", f"SELECT event_type, count(*) AS count FROM {EV} WHERE TRY_CAST(k AS DOUBLE) > 50 GROUP BY 1"),
    "flt_glob": ("search event_type=p* | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type ILIKE 'p%' GROUP BY 1"),
    "flt_notglob": ("search event_type!=p* | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type NOT ILIKE 'p%' GROUP BY 1"),
    "flt_regex": ("search event_type=~^(click)$ | stats count", "SELECT count(*) AS count FROM events WHERE regexp_matches(event_type, '^(click)$')"),
    "flt_text_order": ('search event_type>"error" | stats count by event_type', "SELECT event_type, count(*) AS count FROM events WHERE event_type > 'error' GROUP BY 1"),
    "flt_text_least": ("search event_type <= error | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type <= 'error' GROUP BY 1"),
    "flt_tilde": ("search event_type:~^[cv]l?i | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE regexp_matches(event_type, '^[cv]l?i') GROUP BY 1"),
    "flt_grouped": ("docs (lang in (EN,de)) | table doc_id,lang", "SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'de') AND contains(text, '(') AND contains(text, ')')"),
    "flt_in": ("search event_type in (CLICK,view) | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE lower(event_type) IN ('click', 'view') GROUP BY 1"),
    "flt_notin": ("search event_type not in (click, view) | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1"),
    "flt_in_num": ("search k in (1,2,3) | stats count", f"SELECT count(*) AS count FROM {EV} WHERE TRY_CAST(k AS DOUBLE) IN (1, 2, 3)"),
    "flt_in_empty": ("search event_type in () | stats count", "SELECT count(*) AS count FROM events WHERE false"),
    "flt_notin_empty": ("search event_type not in () | stats count", "SELECT count(*) AS count FROM events"),
    "flt_free": ("docs license | stats count by lang", "SELECT lang, count(*) AS count FROM documents WHERE text ILIKE '%license%' GROUP BY 1"),
    "flt_phrase": ('docs "this work is licensed" | stats count by source', "SELECT source, count(*) AS count FROM documents WHERE text ILIKE '%this work is licensed%' GROUP BY 1"),
    "flt_all": ("search * | stats count", "SELECT count(*) AS count FROM events"),
    "agg_count_field": ("search | stats count(k) by event_type", f"SELECT event_type, count(k) AS count FROM {EV} GROUP BY 1"),
    "agg_sum": ("search | stats sum(value) by event_type", "SELECT event_type, round(sum(value), 4) AS sum FROM events GROUP BY 1", None, _rounded("sum")),
    "agg_avg": ("search | stats avg(value) by event_type", "SELECT event_type, round(avg(value), 4) AS avg FROM events GROUP BY 1", None, _rounded("avg")),
    "agg_min": ("search | stats min(value) by event_type", "SELECT event_type, min(value) AS min FROM events GROUP BY 1"),
    "agg_max": ("search | stats max(value) by event_type", "SELECT event_type, max(value) AS max FROM events GROUP BY 1"),
    "agg_max_json": ("search | stats max(k) by event_type", f"SELECT event_type, CAST(max(CAST(k AS BIGINT)) AS VARCHAR) AS max FROM {EV} GROUP BY 1"),
    "agg_dc": ("search | stats dc(user_id) by event_type", "SELECT event_type, count(DISTINCT user_id) AS dc FROM events GROUP BY 1"),
    "agg_values": ("search | stats values(event_type) by user_id", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS \"values\" FROM events GROUP BY 1"),
    "agg_list": ("search | stats list(k) by user_id", f"SELECT user_id, left(string_agg(k, ',' ORDER BY k), 4096) AS list FROM {EV} GROUP BY 1"),
    "agg_list_cut": ("docs | stats list(source)", "SELECT left(string_agg(source, ',' ORDER BY source), 4096) AS list FROM documents"),
    "agg_values_cut": ("lineitem | stats values(l_extendedprice) by l_returnflag", "SELECT l_returnflag, left(string_agg(p, ',' ORDER BY p), 4096) AS \"values\" FROM (SELECT DISTINCT l_returnflag, l_extendedprice::VARCHAR AS p FROM lineitem) GROUP BY 1"),
    "agg_json_group": ("search | stats count by k", f"SELECT k, count(*) AS count FROM {EV} GROUP BY 1"),
    "ts_span": ("search | timechart span=1d count", f"SELECT ts // 86400 * 86400 AS bucket, count(*) AS count FROM {EV} GROUP BY 1"),
    "ts_by": ("search | timechart span=6h max(value) by event_type", f"SELECT ts // 21600 * 21600 AS bucket, event_type, max(value) AS max FROM {EV} GROUP BY 1, 2"),
    "ts_auto": ("search event_type=error | timechart count", f"SELECT ts // 900 * 900 AS bucket, count(*) AS count FROM {EV} WHERE event_type = 'error' GROUP BY 1"),
    "where_num": ("search | stats count by user_id | where count > 60", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 60"),
    "where_in": ("search | where event_type in (click,view) | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"),
    "where_json": ("search | where k >= 90 | stats count by k", f"SELECT k, count(*) AS count FROM {EV} WHERE TRY_CAST(k AS DOUBLE) >= 90 GROUP BY 1"),
    "where_regex": ("search | where event_type =~ ^c | stats count", "SELECT count(*) AS count FROM events WHERE regexp_matches(event_type, '^c')"),
    "sort_head": ("search | sort -value | head 7 | fields value", "SELECT value FROM events ORDER BY value DESC LIMIT 7"),
    "limit_n": ("orders | sort o_orderkey | limit 5 | table o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5"),
    "top_k": ("search | top 5 user_id", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "rare_k": ("search | rare 5 user_id", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 5"),
    "dedup": ("search | dedup event_type", f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id, user_id, value, props) AS n FROM {EV}) WHERE n = 1"),
    "dedup_json": ("search | dedup k,event_type", f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY k, event_type ORDER BY ts, event_id, user_id, value, props) AS n FROM {EV}) WHERE n = 1"),
    "rename": ("search event_type=error | rename user_id AS uid, k AS key | table uid,key,user_id", f"SELECT user_id AS uid, k AS key, user_id FROM {EV} WHERE event_type = 'error'"),
    "table_all": ("customer | table *", "SELECT * FROM customer"),
    "rex": ('pages | rex url "https?://(?<host>[a-z0-9.-]+)" | stats count by host', "SELECT nullif(regexp_extract(url, 'https?://([a-z0-9.-]+)', 1), '') AS host, count(*) AS count FROM pages GROUP BY 1"),
    "evst_count": ("search | eventstats count by event_type | table event_id,count", "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS count FROM events"),
    "evst_avg": ("search | eventstats avg(value) by event_type | table event_id,avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS avg FROM events", None, _rounded("avg")),
    "evst_dc": ("search | eventstats dc(user_id) by event_type | table event_id,dc", "SELECT event_id, dc FROM events JOIN (SELECT event_type, count(DISTINCT user_id) AS dc FROM events GROUP BY 1) USING (event_type)"),
    "evst_values": ("search | eventstats values(event_type) by user_id | table event_id,values", "SELECT event_id, v AS \"values\" FROM events JOIN (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS v FROM events GROUP BY 1) USING (user_id)"),
    "evst_all": ("search | eventstats max(value) | table event_id,max", "SELECT event_id, max(value) OVER () AS max FROM events"),
    "evst_sum": ("search | eventstats sum(k) by event_type | table event_id,sum", f"SELECT event_id, sum(CAST(k AS DOUBLE)) OVER (PARTITION BY event_type) AS sum FROM {EV}"),
    "evst_min": ("search | eventstats min(value) by k,event_type | table event_id,min", f"SELECT event_id, min(value) OVER (PARTITION BY k, event_type) AS min FROM {EV}"),
    "evst_list": ("search | eventstats list(k) by user_id | table event_id,list", f"SELECT event_id, v AS list FROM events JOIN (SELECT user_id, left(string_agg(k, ',' ORDER BY k), 4096) AS v FROM {EV} GROUP BY 1) USING (user_id)"),
    "evst_after_head": (
        "search | sort event_id | head 50 | eventstats count by event_type | table event_id,count",
        "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS count FROM (SELECT * FROM events ORDER BY event_id LIMIT 50)",
    ),
    "metric_value": ("metric view value>=100 | stats count", f"SELECT count(*) AS count FROM {METRIC} WHERE name = 'view' AND value >= 100"),
    "metric_value_less": ("metric view value<12.5 | stats count by host", f"SELECT host, count(*) AS count FROM {METRIC} WHERE name = 'view' AND value < 12.5 GROUP BY 1"),
    "metric_value_last": ("metric click value>5 value!=55 | timechart span=1d count", f"SELECT ts // 86400 * 86400 AS bucket, count(*) AS count FROM {METRIC} WHERE name = 'click' AND value <> 55 GROUP BY 1"),
    "metric_label": ("metric view k=7 | stats max(value) by host", f"SELECT host, max(value) AS max FROM {METRIC} WHERE name = 'view' AND json_extract_string(labels, '$.k') = '7' GROUP BY 1"),
    "metric_by": ("metric click by k | stats max(value) by k", f"SELECT json_extract_string(labels, '$.k') AS k, max(value) AS max FROM {METRIC} WHERE name = 'click' GROUP BY 1"),
    "metric_chart": ("metric click | timechart span=1d count", f"SELECT ts // 86400 * 86400 AS bucket, count(*) AS count FROM {METRIC} WHERE name = 'click' GROUP BY 1"),
    "append": (
        "search event_type=click | stats count by user_id | append [search event_type=view | stats count by user_id]",
        "SELECT user_id, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM events WHERE event_type = 'view' GROUP BY 1",
    ),
    "append_missing": ("region | append [nation | fields n_name]", "SELECT r_regionkey, r_name, NULL AS n_name FROM region UNION ALL SELECT NULL, NULL, n_name FROM nation"),
    "join": (
        "search event_type=click | stats count by user_id | join user_id [search event_type=view | stats max(value) by user_id]",
        "SELECT a.user_id, a.count, b.max FROM (SELECT user_id, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1) a LEFT JOIN (SELECT user_id, max(value) AS max FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)",
    ),
    "join_computed": (
        'search event_type=click | eval key = "u" . user_id | stats count by key | join key [search event_type=view | eval key = "u" . user_id | stats max(value) by key]',
        "SELECT 'u' || a.user_id AS key, a.count, b.max FROM (SELECT user_id, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1) a LEFT JOIN (SELECT user_id, max(value) AS max FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)",
    ),
    "lookup": ("customer | lookup nation c_nationkey OUTPUT n_name | stats count by n_name", "SELECT n_name, count(*) AS count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "lookup_raw": ("customer | lookup nation c_nationkey | stats count(nation)", "SELECT count(n_nationkey) AS count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "mvexpand": ('search | eval parts = "[" . k . ",1]" | mvexpand parts | stats count by parts', f"SELECT parts, count(*) AS count FROM (SELECT unnest([k, '1']) AS parts FROM {EV}) GROUP BY 1"),
    "mvexpand_object": ("search | mvexpand props | stats count by props", f"SELECT k AS props, count(*) AS count FROM {EV} GROUP BY 1"),
    "topk_star": ("lineitem | stats sum(l_quantity) by l_returnflag | sort -sum", "SELECT l_returnflag, sum(l_quantity) AS sum FROM lineitem GROUP BY 1"),
    "star_join": (
        "orders | stats sum(o_totalprice) by o_custkey | join o_custkey [customer | rename c_custkey AS o_custkey | fields o_custkey,c_mktsegment] | stats sum(sum) by c_mktsegment",
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS sum FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        None,
        lambda df: df.withColumn("sum", F.round("sum", 2)),
    ),
    "deep_chain": (
        "lineitem l_quantity>10 | eval revenue = l_extendedprice * (1 - l_discount) | stats sum(revenue) by l_orderkey | where sum > 50000 | stats count",
        "SELECT count(*) AS count FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 GROUP BY 1 HAVING sum(l_extendedprice * (1 - l_discount)) > 50000)",
    ),
    "row_filter": ("search | stats count by user_id", "SELECT user_id, count(*) AS count FROM events WHERE user_id IN (1, 2, 3) GROUP BY 1", lambda s: s.with_row_filter("user_id", [1, 2, 3])),
    "row_filter_metric": ("metric view | stats count by host", f"SELECT host, count(*) AS count FROM {METRIC} WHERE name = 'view' AND user_id IN (1, 2, 3) GROUP BY 1", lambda s: s.with_row_filter("user_id", [1, 2, 3])),
    "time_window": ("search event_type=view | table event_id,ts", f"SELECT event_id, ts FROM {EV} WHERE event_type = 'view' AND {IN_TIME}", None, None, (FROM, UNTIL)),
    "time_from": ("search | stats count by event_type", f"SELECT event_type, count(*) AS count FROM {EV} WHERE ts >= {FROM} GROUP BY 1", None, None, (FROM, 0)),
    "time_sub": ("search event_type=view | append [search event_type=click] | table event_id", f"SELECT event_id FROM {EV} WHERE event_type IN ('view', 'click') AND {IN_TIME}", None, None, (FROM, UNTIL)),
    "metric_window": ("metric view by k | stats count by host", f"SELECT host, count(*) AS count FROM {METRIC} WHERE name = 'view' AND {IN_TIME} GROUP BY 1", None, None, (FROM, UNTIL)),
    "ts_auto_window": ("search | timechart count by event_type", f"SELECT ts // 14400 * 14400 AS bucket, event_type, count(*) AS count FROM {EV} WHERE {IN_TIME} GROUP BY 1, 2", None, None, (FROM, UNTIL)),
    "row_filter_empty": ("search | stats count", "SELECT 0::BIGINT AS count", lambda s: s.with_row_filter("user_id", [])),
    "env": ("search | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_id % 2 = 0 GROUP BY 1", lambda s: s.with_env("prod")),
    "mask_real": ("search | stats count by event_type", "SELECT '***' AS event_type, count(*) AS count FROM events", lambda s: s.with_masks({"event_type": "mask"})),
    "mask_partial": ("search | stats count by event_type", "SELECT '***' || right(event_type, 4) AS event_type, count(*) AS count FROM events GROUP BY 1", lambda s: s.with_masks({"event_type": "partial"})),
    "mask_hash": ("search | stats count by event_type", "SELECT sha256('s1' || event_type) AS event_type, count(*) AS count FROM events GROUP BY 1", lambda s: s.with_masks({"event_type": "hash"}, "s1")),
    "mask_redact": ("search | stats count by k", "SELECT NULL AS k, count(*) AS count FROM events", lambda s: s.with_masks({"k": "redact"})),
    "mask_bag": ("search | stats count by props", "SELECT '{}' AS props, count(*) AS count FROM events", lambda s: s.with_masks({"k": "deny"})),
    "mask_bag_keeps": ("search | stats count by props", f"SELECT '{{\"k\":' || k || '}}' AS props, count(*) AS count FROM {EV} GROUP BY 1", lambda s: s.with_masks({"other": "deny"})),
    "mask_output_bag": ("search event_type=view", f"SELECT event_id, ts, user_id, event_type, value, '{{}}' AS props FROM {EV} WHERE event_type = 'view'", lambda s: s.with_masks({"k": "deny"})),
    "mask_eval_bag": ("search | eval copy = PROPS | table event_id,copy,k", "SELECT event_id, '{}' AS copy, '***' AS k FROM events", lambda s: s.with_masks({"k": "mask"})),
    "mask_append": (
        "search event_type=view | table event_type,user_id | append [search event_type=click | table event_type,user_id]",
        "SELECT event_type, '***' || right(user_id::VARCHAR, 4) AS user_id FROM events WHERE event_type IN ('view', 'click')",
        lambda s: s.with_masks({"user_id": "partial"}),
    ),
    "mask_join": (
        "search event_type=click | stats count by user_id | join user_id [search event_type=view | stats count(k) by user_id | rename count AS views | fields user_id,views]",
        "SELECT sha256('s2' || a.user_id) AS user_id, a.count, b.views FROM (SELECT user_id, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1) a LEFT JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)",
        lambda s: s.with_masks({"user_id": "hash"}, "s2"),
    ),
    "cursor": ("search event_type=signup | table event_id", "SELECT event_id FROM events WHERE event_type = 'signup'", lambda s: s.with_cursor_id().with_message_pruning()),
    "ko_alias": ("search kind_of=click | stats count by kind_of", "SELECT event_type AS kind_of, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1", lambda s: s.with_knowledge(Knowledge(aliases=KNOWLEDGE.aliases))),
    "ko_calc": ("search | stats max(double_value) by event_type", "SELECT event_type, max(value * 2) AS max FROM events GROUP BY 1", lambda s: s.with_knowledge(Knowledge(calculated=KNOWLEDGE.calculated))),
    "ko_eventtype": ("search eventtype=bought | stats count", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase' AND value >= 50", lambda s: s.with_knowledge(KNOWLEDGE)),
    "ko_tag": ("search tag=seen | stats count by event_type", "SELECT event_type, count(*) AS count FROM events WHERE event_type IN ('view', 'click') GROUP BY 1", lambda s: s.with_knowledge(KNOWLEDGE)),
    "ko_macro": ("search `of(click)` | stats count", "SELECT count(*) AS count FROM events WHERE event_type = 'click'", lambda s: s.with_knowledge(KNOWLEDGE)),
    "ko_lookup": ("search | stats count by n_name", "SELECT n_name, count(*) AS count FROM events LEFT JOIN nation ON user_id = n_nationkey GROUP BY 1", lambda s: s.with_knowledge(Knowledge(lookups=KNOWLEDGE.lookups))),
}
PURCHASES = f"(SELECT *, json_extract_string(labels, '$.k') AS k FROM {METRIC} WHERE name = 'purchase')"
QUERIES["rate"] = (
    "metric purchase by k | rate | stats count(rate)",
    f"""SELECT count(*) FILTER (v >= 0 AND t > 0) AS count FROM (SELECT value - lag(value) OVER w AS v, ts - lag(ts) OVER w AS t
    FROM {PURCHASES} WINDOW w AS (PARTITION BY host, k ORDER BY ts, value))""",
)
QUERIES["rate_rows"] = (
    "metric purchase by k | rate | table ts,host,k,rate",
    f"""SELECT ts, host, k, round(CASE WHEN v >= 0 AND t > 0 THEN v / t END, 6) AS rate FROM (SELECT *, value - lag(value) OVER w AS v, ts - lag(ts) OVER w AS t
    FROM {PURCHASES} WINDOW w AS (PARTITION BY host, k ORDER BY ts, value))""",
    None,
    lambda df: df.withColumn("rate", F.round("rate", 6)),
)

#: eval expressions by name, with SQL over EV's columns.
EXPRESSIONS = {
    "if": ("if(value > 100, 'high', 'low')", "CASE WHEN value > 100 THEN 'high' ELSE 'low' END"),
    "coalesce": ("coalesce(nothing, event_type)", "event_type"),
    "ifnull": ("ifnull(nothing, 'none')", "'none'"),
    "nullif": ("nullif(event_type, 'click')", "nullif(event_type, 'click')"),
    "lower_upper": ("lower(upper(event_type))", "event_type"),
    "length": ("length(event_type) + len(event_type)", "2 * length(event_type)"),
    "abs": ("abs(0 - user_id)", "user_id"),
    "round": ("round(value, 1)", "floor(value * 10 + 0.5) / 10"),
    "min_max": ("max(min(user_id, 50), 10)", "greatest(least(user_id, 50), 10)"),
    "substr": ("substr(event_type, 2, 3)", "substr(event_type, 2, 3)"),
    "substr_edges": ("substr(event_type, 0, 3) . substr(event_type, -3, 2)", "substr(event_type, 1, 2) || substr(event_type, length(event_type) - 2, 2)"),
    "replace": ("replace(event_type, 'i', '1')", "replace(event_type, 'i', '1')"),
    "trim": ("trim('  x ') . trim('--y-', '-')", "'xy'"),
    "integers": ("(user_id + 7) / 3 - user_id % 4 * 2", "(user_id + 7) // 3 - user_id % 4 * 2"),
    "by_zero": ("coalesce(user_id / 0, user_id % 0, 5)", "5"),
    "json_number": ("k * 2", "CAST(k AS DOUBLE) * 2"),
    "like": ("if(event_type like 'C%', 1, 0)", "CASE WHEN event_type ILIKE 'C%' THEN 1 ELSE 0 END"),
    "glob": ("if(event_type glob 'c*', 1, 0)", "CASE WHEN event_type LIKE 'c%' THEN 1 ELSE 0 END"),
    "in_between": ("if(event_type in ('click', 'view') and user_id between 5 and 50, 1, 0)", "CASE WHEN event_type IN ('click', 'view') AND user_id BETWEEN 5 AND 50 THEN 1 ELSE 0 END"),
    "logic": ("if(not (value > 50 or event_type == 'view') and nothing is null, 'a', 'b')", "CASE WHEN NOT (value > 50 OR event_type = 'view') THEN 'a' ELSE 'b' END"),
}
QUERIES |= {f"eval_{n}": (f"search | eval made = {e} | table event_id,made", f"SELECT event_id, {sql} AS made FROM {EV}") for n, (e, sql) in EXPRESSIONS.items()}


#: Findings and run records made of events: what is joined is the parent technique.
TECHNIQUE = "1000 + k::BIGINT"


def _mitre(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", epoch("ts").alias("ts"), F.concat(F.lit("T"), 1000 + F.get_json_object("props", "$.k").cast("bigint")).alias("mitre"))
    base = engagements()
    blank = lambda df, columns: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    finding = events.where("event_type = 'error'").groupBy("mitre").agg(F.min("ts").alias("ts"), F.lit("seen").alias("title"))
    runs = events.where("event_type = 'signup'").withColumn("mitre", F.concat(F.lower("mitre"), F.lit(".001"))).withColumn("kind", F.col("event_type"))
    tables = {"finding": blank(finding, (*base.default.columns, "engagement_id")), "runrecord": blank(runs, (*base.alternatives[0].columns, "engagement_id"))}
    return Engine(catalog(spark, sf_dir).with_tables(**tables), base).query("runs | table ts,mitre | join mitre [search | table mitre,title] | stats count by mitre,title")


def _tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit(" t"), 1000 + 7 * F.get_json_object("props", "$.k").cast("bigint"), F.lit(".002\t")).alias("technique"))
    found = attack.with_tactic(ids, "technique")
    return found.select("event_id", "tactic", attack.normalized(F.col("technique")).alias("parent"))


#: Indicators from a bundle, looked for in pages.
BUNDLE = [{"type": "indicator", "id": "i1", "pattern": "[url:value = ' HTTP://thther.example.com/DE/83?page=2&ref=x' OR domain-name:value = '*.M.tionsh.example.net.' OR domain-name:value = 'thther.example.org' OR domain-name:value = 'blog.tionsh.example.net']"}]


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat(F.regexp_extract("url", "://([^/]+)", 1), F.lit(".\n")).alias("host"))
    return indicators.match(pages, indicators.import_bundle(BUNDLE).frame(spark), {"url": "url", "host": "domain"}).select("page_id", "ioc_kind", "ioc_value")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 by time and id."""
    tables = catalog(spark, sf_dir)
    timed = tables.with_tables(events=Bounded(lambda a, b: tables.table("events", a, b).withColumnRenamed("event_id", "id")))
    base = Base("search", "events", ("ts", "event_type"), ("id",), None, None)
    engine = Engine(timed, Schema(base))
    (last,) = engine.page("search event_type=view", 20).orderBy("ts", "id").limit(1).collect()
    return engine.page("search event_type=view", 20, (last["ts"], last["id"]))


#: name: (function, SQL)
FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "join_mitre": (
        _mitre,
        f"""WITH f AS (SELECT DISTINCT 'T' || ({TECHNIQUE}) AS mitre FROM {EV} WHERE event_type = 'error')
        SELECT 't' || ({TECHNIQUE}) || '.001' AS mitre, CASE WHEN f.mitre IS NOT NULL THEN 'seen' END AS title, count(*) AS count
        FROM {EV} LEFT JOIN f ON f.mitre = 'T' || ({TECHNIQUE}) WHERE event_type = 'signup' GROUP BY ALL""",
    ),
    "domain_tactic": (
        _tactics,
        f"""SELECT event_id, tactic, 'T' || (1000 + 7 * k::BIGINT) AS parent FROM {EV}
        LEFT JOIN (VALUES {", ".join(f"('{t}', '{tactic}')" for t, tactic in attack.CATALOG)}) c(technique, tactic) ON technique = 'T' || (1000 + 7 * k::BIGINT)""",
    ),
    "domain_indicators": (
        _indicators,
        """SELECT page_id, 'url' AS ioc_kind, lower(url) AS ioc_value FROM pages WHERE lower(url) = 'http://thther.example.com/de/83?page=2&ref=x'
        UNION ALL SELECT page_id, 'domain', lower(regexp_extract(url, '://([^/]+)', 1)) AS host FROM pages WHERE host IN ('m.tionsh.example.net', 'thther.example.org', 'blog.tionsh.example.net')""",
    ),
    "page_second": (_paged, f"SELECT ts, event_type, event_id AS id FROM {EV} WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20"),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name in FUNCTIONS:
        return FUNCTIONS[name][0](spark, sf_dir)
    text, _, *more = QUERIES[name]
    change, after, bounds = (*more, *(None, None, (0, 0))[len(more) :])
    found: Schema = change(schema()) if change else schema()
    df = Engine(catalog(spark, sf_dir), found).query(text, *bounds)
    return after(df) if after else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, n=n: run(n, spark, sf_dir)) for n in (*QUERIES, *FUNCTIONS)}


def oracle_sql() -> dict[str, str]:
    return {n: q[1] for n, q in (QUERIES | FUNCTIONS).items()}
