"""Web-firewall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions.text import printable
from logloom.operators import counters as c
from logloom.operators import filters, health, lines, metrics, reports, rules, series, waf
from logloom.plans import sqlparts as q
from logloom.plans.registry import Query

T = 5
W = "waf_requests"
RULES_OF = "[r for r in string_split(count_rules_csv, ',') if r <> '']"
LABELS = "(SELECT *, unnest(labels) AS label FROM waf_requests)"
COUNT_ROWS = f"(SELECT *, unnest({RULES_OF}) AS count_rule FROM waf_requests)"
MATCH = (
    "CASE WHEN action = 'ALLOW' THEN CASE WHEN count_rules_csv LIKE 'AWSManagedRulesCommonRuleSet/%' THEN 'AWSManagedRulesCommonRuleSet/SizeRestrictions_BODY' "
    "WHEN list_contains(labels, 'awswaf:managed:aws:core-rule-set:X') THEN 'awswaf:managed:aws:core-rule-set:X' END END"
)
URI = q.normalized("uri")
FIRST = "(SELECT min(ts) FROM waf_requests)"

DIMS = {
    "action": ("action", "TRUE"), "acl": ("web_acl", "TRUE"), "rule": ("rule", "action <> 'ALLOW'"),
    "rule_group": ("rule_group", "TRUE"), "client_ip": ("client_ip", "TRUE"), "country": ("country", "TRUE"),
    "host": ("host", "TRUE"), "uri": (URI, "TRUE"), "method": ("method", "TRUE"), "user_agent": ("user_agent", "TRUE"),
    "source": ("source", "TRUE"), "ja4": ("ja4", "TRUE"), "response_code": ("response_code", "response_code > 0"),
    "label": ("label", "TRUE", None, LABELS), "count_rule": ("count_rule", "TRUE", None, COUNT_ROWS),
    "blocked_client_ip": ("client_ip", "action = 'BLOCK'"),
    "blocked_country": ("country", "action = 'BLOCK' AND client_ip IS NOT NULL"), "oversize_client_ip": ("client_ip", "oversize"),
}
TOTALS = (
    "SELECT count(*) AS requests, count(*) FILTER (count_rules_csv <> '') AS counted, count(*) FILTER (oversize) AS oversize, min(ts) AS first, max(ts) AS last, "
    "count(*) FILTER (action = 'BLOCK') AS blocked, round(count(*) FILTER (action = 'BLOCK') / count(*), 6) AS block_rate FROM waf_requests"
)
CLIENTS = (
    "SELECT client_ip, count(*) FILTER (action = 'BLOCK') AS blocks, count(*) FILTER (action = 'ALLOW') AS allows, count(rate_rule) AS rate_limited, "
    "count(*) FILTER (challenge_failed) AS challenge_fails FROM waf_requests WHERE client_ip IS NOT NULL GROUP BY 1"
)
MATCHES = f"SELECT client_ip, {MATCH} AS match, ts, uri FROM waf_requests WHERE {MATCH} IS NOT NULL"
EXPLOITS = (
    "SELECT coalesce(client_ip, '') AS ip, count(*) AS n, min(ts) AS first, arg_min(uri, {'a': ts, 'b': uri}) AS uri "
    f"FROM ({MATCHES}) GROUP BY 1"
)
TOP_MATCHES = (
    "SELECT ip, string_agg(match, ', ' ORDER BY n DESC, match) FILTER (place <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY n DESC, match) AS place FROM "
    f"(SELECT coalesce(client_ip, '') AS ip, match, count(*) AS n FROM ({MATCHES}) GROUP BY 1, 2)) GROUP BY 1"
)
RULES = {
    "waf-exploit-allowed": q.finding(
        "waf-exploit-allowed", "CRITICAL", "Exploit payload allowed", "ip",
        "n || ' allowed requests matched COUNT-mode exploit rules (' || top || '); first at ' || uri", "first", "n",
        f"FROM ({EXPLOITS}) JOIN ({TOP_MATCHES}) USING (ip)",
    ),
    "waf-attacker-allowed": q.finding(
        "waf-attacker-allowed", "HIGH", "Blocked client also allowed", "client_ip",
        "blocks || ' blocked and ' || allows || ' allowed requests'", FIRST, "blocks",
        f"FROM ({CLIENTS}) WHERE blocks >= {T} AND allows > 0",
    ),
    "waf-persistent-blocked-ip": q.finding(
        "waf-persistent-blocked-ip", "MEDIUM", "Persistent blocked client", "client_ip", "blocks || ' blocked requests'", FIRST, "blocks",
        f"FROM ({CLIENTS}) WHERE blocks >= {T} AND allows = 0",
    ),
    "waf-challenge-failures": q.finding(
        "waf-challenge-failures", "LOW", "Repeated CAPTCHA or challenge failures", "client_ip",
        "challenge_fails || ' failed CAPTCHA or challenge responses'", FIRST, "challenge_fails",
        f"FROM ({CLIENTS}) WHERE challenge_fails >= 1",
    ),
    "waf-rate-limited": q.finding(
        "waf-rate-limited", "HIGH", "Rate limit triggered", "rate_rule", "total || ' requests limited; top clients: ' || top", FIRST, "total",
        "FROM (SELECT rate_rule, CAST(sum(n) AS BIGINT) AS total, string_agg(client_ip || ' (' || n || ')', ', ' ORDER BY n DESC, client_ip) FILTER (place <= 5) AS top FROM "
        "(SELECT *, row_number() OVER (PARTITION BY rate_rule ORDER BY n DESC, client_ip) AS place FROM (SELECT rate_rule, client_ip, count(*) AS n FROM waf_requests "
        "WHERE rate_rule IS NOT NULL AND client_ip IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)",
    ),
    "waf-count-rule": q.finding(
        "waf-count-rule", "MEDIUM", "COUNT rule would block", "count_rule", "n || ' requests matched this rule in COUNT mode'", FIRST, "n",
        f"FROM (SELECT count_rule, count(*) AS n FROM {COUNT_ROWS} GROUP BY 1)",
    ),
    "waf-oversize": q.finding(
        "waf-oversize", "MEDIUM", "Request fields over the inspection limit", "''",
        "n || ' requests had a body, headers, or cookies larger than WAF inspects'", FIRST, "n",
        "FROM (SELECT count(*) AS n FROM waf_requests WHERE oversize) WHERE n > 0",
    ),
}
ALL_SQL = " UNION ALL ".join(RULES.values())


def findings(t):
    return rules.waf_findings(t.waf_requests, block_threshold=T)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}

    def one(dim):
        return lambda t: c.counter(t.waf_requests, waf.dims()[dim])

    names = {
        "agg_wf_02": "action", "agg_wf_03": "acl", "agg_wf_04": "rule", "agg_wf_05": "rule_group", "agg_wf_06": "client_ip",
        "agg_wf_07": "country", "agg_wf_08": "host", "agg_wf_09": "uri", "agg_wf_10": "method", "agg_wf_11": "user_agent",
        "agg_wf_12": "source", "agg_wf_13": "ja4", "agg_wf_14": "response_code", "agg_wf_15": "label", "agg_wf_16": "count_rule",
        "agg_wf_17_ip": "blocked_client_ip", "agg_wf_17_country": "blocked_country", "agg_wf_22": "oversize_client_ip",
    }
    for name, dim in names.items():
        spec = DIMS[dim]
        out[name] = Query(one(dim), q.counter(spec[3] if len(spec) > 3 else W, *spec[:3]))
    for i, rule in enumerate(RULES, 1):
        out[f"rul_wf_0{i}"] = Query(
            lambda t, r=rule: rules.waf_findings(t.waf_requests, block_threshold=T, rules=[r]), RULES[rule]
        )
    out |= {
        "agg_wf_01": Query(lambda t: waf.totals(t.waf_requests), TOTALS),
        "agg_wf_counters": Query(lambda t: waf.counters(t.waf_requests), q.counters(W, DIMS)),
        "agg_wf_18": Query(
            lambda t: waf.hour_by_action(t.waf_requests),
            "SELECT date_trunc('hour', ts) AS hour, action, count(*) AS n FROM waf_requests GROUP BY 1, 2",
        ),
        "agg_wf_19": Query(lambda t: waf.client_counts(t.waf_requests), CLIENTS),
        "agg_wf_20": Query(
            lambda t: waf.rate_rule_clients(t.waf_requests),
            "SELECT rate_rule, client_ip, count(*) AS n FROM waf_requests WHERE rate_rule IS NOT NULL GROUP BY 1, 2",
        ),
        "agg_wf_21": Query(
            lambda t: waf.client_stats(t.waf_requests).where("exploits > 0").select(
                F.col("client").alias("ip"), F.col("exploits").alias("n"), F.col("exploit_first").alias("first"), F.col("exploit_uri").alias("uri")
            ),
            EXPLOITS,
        ),
        "agg_wf_21_matches": Query(
            lambda t: waf.exploit_matches(t.waf_requests),
            f"SELECT client_ip, match, count(*) AS n FROM ({MATCHES}) GROUP BY 1, 2",
        ),
        "agg_wf_23": Query(lambda t: waf.distinct_clients(t.waf_requests), "SELECT count(DISTINCT client_ip) AS client_ips FROM waf_requests"),
        "prj_29": Query(
            lambda t: t.waf_requests.groupBy(waf.exploit().alias("match"), "action").count(),
            f"SELECT {MATCH} AS match, action, count(*) AS count FROM waf_requests GROUP BY 1, 2",
        ),
        "prj_45": Query(
            lambda t: t.read("documents").select(
                "doc_id", F.length(printable(F.col("text"))).alias("n"), F.md5(printable(F.col("text"))).alias("digest")
            ),
            "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', ' ', 'g') AS t FROM documents)",
        ),
        "flt_14": Query(
            lambda t: filters.WafFilter(actions=["block", "Captcha"], countries=["nl", "us"], rule="sqli", uri="/ITEM/1", host="EXAMPLE", client_ip="100.1")
            .apply(t.waf_requests).groupBy("action", "country", "uri").count(),
            "SELECT action, country, uri, count(*) AS count FROM waf_requests WHERE action IN ('BLOCK', 'CAPTCHA') AND country IN ('NL', 'US') AND contains(lower(rule), 'sqli') "
            "AND contains(lower(uri), '/item/1') AND contains(lower(host), 'example') AND contains(client_ip, '100.1') GROUP BY 1, 2, 3",
        ),
        "set_03": Query(
            lambda t: t.waf_requests.select(
                F.array_join(F.array_distinct(F.concat("count_rules", F.array(F.lit("geo-watch")), "count_rules")), ",").alias("rules")
            ).groupBy("rules").count(),
            "SELECT CASE WHEN count_rules_csv = '' THEN 'geo-watch' ELSE count_rules_csv END AS rules, count(*) AS count FROM waf_requests GROUP BY 1",
        ),
        "set_04": Query(
            lambda t: t.waf_requests.select("web_acl").where("web_acl is not null").distinct().orderBy("web_acl"),
            "SELECT DISTINCT web_acl FROM waf_requests ORDER BY 1",
        ),
        "rul_wf_all": Query(findings, ALL_SQL),
        "rnk_06_waf": Query(lambda t: rules.cap_aggregate(findings(t), 20), q.capped(ALL_SQL, 20)),
        "rnk_11_waf": Query(
            lambda t: reports.waf_tables(t.waf_requests), q.tables(q.counters(W, DIMS), reports.WAF_TABLES, "requests", set(), 10, q.VALUE_TONE)
        ),
        "tsr_07": Query(
            lambda t: series.hourly_breakdown(waf.hour_by_action(t.waf_requests), "action"),
            "SELECT hour, CAST(sum(n) AS BIGINT) AS n, string_agg(action || ' ' || n, ', ' ORDER BY n DESC, action) AS breakdown FROM "
            "(SELECT date_trunc('hour', ts) AS hour, action, count(*) AS n FROM waf_requests GROUP BY 1, 2) GROUP BY 1",
        ),
        "hlt_06_waf": Query(
            lambda t: health.waf_summary(t.waf_requests),
            "UNPIVOT (SELECT CAST(requests AS VARCHAR) AS requests, CAST(blocked AS VARCHAR) AS blocked, CAST((SELECT count(*) FROM waf_requests WHERE action = 'ALLOW') AS VARCHAR) AS allowed, "
            "CAST(counted AS VARCHAR) AS counted, CAST((SELECT count(*) FROM waf_requests WHERE action IN ('CAPTCHA', 'CHALLENGE')) AS VARCHAR) AS challenged, CAST(block_rate AS VARCHAR) AS block_rate, "
            f"CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last FROM ({TOTALS})) ON COLUMNS(*) INTO NAME metric VALUE value",
        ),
        "hlt_07_waf": Query(
            lambda t: health.waf_matches(t.waf_requests, 100),
            "SELECT ts, web_acl, action, rule, client_ip, country, method, host, uri, user_agent FROM waf_requests ORDER BY ts, web_acl, action, rule, client_ip NULLS FIRST LIMIT 100",
        ),
        "met_08_waf": Query(
            lambda t: waf.action_by_source(t.waf_requests),
            "SELECT source, action, count(*) AS n FROM waf_requests WHERE source IS NOT NULL GROUP BY 1, 2",
        ),
        "snk_02": Query(
            lambda t: lines.finding_lines(findings(t), "run", "waf").select(
                "at", F.from_json("line", "rule string, severity string, actor string, detail string").alias("j"), lines.labels_text(F.col("labels")).alias("labels")
            ).select("at", "j.*", "labels"),
            "SELECT time AS at, rule, lower(severity) AS severity, nullif(actor, '') AS actor, detail, 'job=logloom,kind=finding,severity=' || lower(severity) || ',subcommand=waf' AS labels "
            f"FROM ({ALL_SQL})",
        ),
        "snk_04": Query(
            lambda t: lines.waf_lines(t.waf_requests, "run").select(
                "at", F.from_json("line", "web_acl string, action string, client_ip string, labels array<string>, count_rules array<string>, response_code int, oversize boolean, challenge_failed boolean").alias("j"),
                lines.labels_text(F.col("labels")).alias("stream"),
            ).select(
                "at", "j.web_acl", "j.action", "j.client_ip", F.array_join("j.labels", ",").alias("labels"), F.array_join("j.count_rules", ",").alias("count_rules"),
                "j.response_code", "j.oversize", "j.challenge_failed", "stream",
            ),
            "SELECT ts AS at, web_acl, action, client_ip, array_to_string(labels, ',') AS labels, nullif(count_rules_csv, '') AS count_rules, nullif(response_code, 0) AS response_code, "
            "CASE WHEN oversize THEN true END AS oversize, CASE WHEN challenge_failed THEN true END AS challenge_failed, "
            "'acl=' || web_acl || ',action=' || action || ',job=logloom,kind=request,subcommand=waf' AS stream FROM waf_requests",
        ),
        "snk_13_waf": Query(
            lambda t: metrics.waf_gauges(
                t.waf_requests, rules.cap_aggregate(findings(t), 500), t.waf_requests.select("web_acl").distinct()
            ).select("name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value"),
            "SELECT 'logloom_waf_requests' AS name, 'gauge' AS type, 'action=' || a.action AS labels, CAST(count(f.action) AS DOUBLE) AS value FROM "
            "(VALUES ('ALLOW'), ('BLOCK'), ('COUNT'), ('CAPTCHA'), ('CHALLENGE')) a(action) LEFT JOIN waf_requests f USING (action) GROUP BY a.action "
            f"UNION ALL SELECT 'logloom_waf_findings', 'gauge', 'severity=' || lower(severity), n FROM ({q.severity_counts(q.capped(ALL_SQL, 500))}) "
            "UNION ALL SELECT 'logloom_waf_web_acls', 'gauge', '', count(DISTINCT web_acl) FROM waf_requests",
        ),
        "prj_43": Query(
            lambda t: findings(t).groupBy("severity", d.severity_tone(F.col("severity")).alias("tone")).count(),
            f"SELECT severity, CASE severity WHEN 'MEDIUM' THEN 'warn' WHEN 'LOW' THEN 'info' ELSE 'crit' END AS tone, count(*) AS count FROM ({ALL_SQL}) GROUP BY 1, 2",
        ),
    }
    return out
