"""Derived fields of each log family (pure Column functions over canonical columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import present

# Fixed values -------------------------------------------------------------

# Verbs of calls that do not change state, used when readOnly is missing.
READ_VERBS = (
    "Describe", "Get", "List", "Lookup", "Search", "Query", "Head", "BatchGet", "Scan", "Select", "Assume",
    "Filter", "Estimate", "Validate", "Preview", "Simulate", "Check", "Test", "View", "Read", "Discover", "Resolve",
)
# Deprecated TLS versions as load balancers name them.
LB_WEAK_TLS = ("SSLv3", "TLSv1", "TLSv1.1")
# TLS below 1.2 as object-access logs name it.
OBJECT_WEAK_TLS = ("TLSv1", "TLSv1.0", "TLSv1.1")
# Object-access operation classes.
OBJECT_WRITES = (
    "REST.PUT.OBJECT", "REST.POST.OBJECT", "REST.COPY.OBJECT", "REST.POST.UPLOADS", "REST.PUT.PART",
    "REST.COPY.PART", "REST.POST.UPLOAD",
)
OBJECT_DELETES = ("REST.DELETE.OBJECT", "BATCH.DELETE.OBJECT")
OBJECT_MULTI_DELETE = "REST.POST.MULTI_OBJECT_DELETE"
OBJECT_READS = (
    "REST.GET.OBJECT", "REST.HEAD.OBJECT", "REST.GET.BUCKET", "REST.GET.BUCKETVERSIONS", "REST.COPY.OBJECT_GET",
)
OBJECT_ACCESS_CHANGES = (
    "REST.PUT.BUCKETPOLICY", "REST.DELETE.BUCKETPOLICY", "REST.PUT.ACL", "REST.PUT.PUBLIC_ACCESS_BLOCK",
    "REST.DELETE.PUBLIC_ACCESS_BLOCK",
)
# Managed rule groups and labels that detect injection and known exploits.
EXPLOIT_GROUPS = (
    "AWSManagedRulesSQLiRuleSet/", "AWSManagedRulesKnownBadInputsRuleSet/", "AWSManagedRulesCommonRuleSet/",
)
EXPLOIT_LABELS = (
    "awswaf:managed:aws:sql-database:", "awswaf:managed:aws:known-bad-inputs:", "awswaf:managed:aws:core-rule-set:",
)
# IANA protocol numbers with a short name.
PROTOCOL_NAMES = {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah", 58: "icmpv6", 132: "sctp"}
ANONYMOUS = "anonymous"


def yes(c: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(c, F.lit(False))


# Audit events --------------------------------------------------------------


def actor(arn: Column, invoked_by: Column, user_name: Column, principal_id: Column) -> Column:
    """Most human-meaningful caller identifier."""
    return F.coalesce(
        present(arn), present(invoked_by), present(user_name), present(principal_id), F.lit("unknown")
    )


def service_name(event_source: Column) -> Column:
    return present(F.regexp_replace(event_source, r"\.amazonaws\.com$", ""))


def is_write(read_only: Column, event_name: Column) -> Column:
    """Trust readOnly when present, else infer from the verb."""
    looks_read = F.rlike(event_name, F.lit("^(?:" + "|".join(READ_VERBS) + ")"))
    return F.coalesce(~read_only, ~looks_read & (event_name != ""), F.lit(False))


def json_text(raw: Column, field: str) -> Column:
    """String field of a raw JSON object; NULL when missing or not a string."""
    doc = F.try_parse_json(raw)
    is_text = F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(doc, f"$.{field}", "string"))


# Load balancer -------------------------------------------------------------


def host_or_sni(host: Column, domain: Column) -> Column:
    return F.coalesce(present(host), present(domain))


def target_conn_error(error_reason: Column, elb_status: Column, target: Column, target_status: Column) -> Column:
    """The load balancer could not deliver the request to its target."""
    return yes(F.startswith(error_reason, F.lit("TargetConnection"))) | yes(
        (elb_status == "502") & target.isNotNull() & target_status.isNull()
    )


def handshake_failed(listener: Column, ssl_protocol: Column) -> Column:
    """Connection to the HTTPS port that never negotiated TLS."""
    return yes((listener == "443") & ssl_protocol.isNull())


def total_latency(request_time: Column, target_time: Column, response_time: Column) -> Column:
    return request_time + target_time + response_time


def normalize_path(path: Column) -> Column:
    """Numeric path segments become ``{n}``, keeping an extension."""
    return F.regexp_replace(path, r"(^|/)[0-9]+(?=[./]|$)", "$1{n}")


def status_digit(status: Column) -> Column:
    """Class digit 1-5 of a three-character status, else 0."""
    return F.when(F.rlike(status, F.lit("(?s)^[1-5]..$")), F.substring(status, 1, 1).cast("int")).otherwise(0)


def metric_status_class(status: Column) -> Column:
    """2xx-5xx, else ``other`` (1xx included)."""
    return F.when(
        F.rlike(status, F.lit("(?s)^[2-5]..$")), F.concat(F.substring(status, 1, 1), F.lit("xx"))
    ).otherwise("other")


def ring_status_class(status: Column) -> Column:
    """1xx-5xx, else ``other``."""
    return F.when(
        F.rlike(status, F.lit("(?s)^[1-5]..$")), F.concat(F.substring(status, 1, 1), F.lit("xx"))
    ).otherwise("other")


def target_group_name(arn: Column) -> Column:
    return F.regexp_replace(arn, r"(?s)^.*?:targetgroup/", "")


def listener_tls(listener: Column, ssl_protocol: Column) -> Column:
    """``443 TLSv1.3`` or ``443 no TLS``; NULL without a listener."""
    return F.concat(listener, F.lit(" "), F.coalesce(ssl_protocol, F.lit("no TLS")))


# Web firewall --------------------------------------------------------------


def acl_name(arn: Column) -> Column:
    return present(
        F.when(F.contains(arn, F.lit("/webacl/")), F.regexp_extract(arn, r"(?s)/webacl/([^/]*)", 1)).otherwise(arn)
    )


def rule_group_name(group_id: Column) -> Column:
    return (
        F.when(F.contains(group_id, F.lit("#")), F.regexp_extract(group_id, r"(?s)#([^#]*)$", 1))
        .when(F.contains(group_id, F.lit("rulegroup/")), F.regexp_extract(group_id, r"(?s)rulegroup/([^/]*)", 1))
        .otherwise(F.coalesce(group_id, F.lit("")))
    )


def header_value(headers: Column, name: str) -> Column:
    """Value of the last header with that name, in any case."""
    matching = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return present(F.element_at(F.nullif(matching, F.array().cast("array<struct<name:string,value:string>>")), -1)["value"])


def label_names(labels: Column) -> Column:
    names = F.transform(labels, lambda x: x["name"])
    return F.coalesce(F.filter(names, lambda n: yes(n != "")), F.array().cast("array<string>"))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _blocks(group: Column) -> Column:
    """The group names a rule that would have terminated the request."""
    return yes(group["terminatingRule"]["ruleId"] != "")


def terminating_group_index(groups: Column, rule_type: Column) -> Column:
    """Index of the group that decided the request: the last that could have."""
    from_group = yes(rule_type.isin("GROUP", "MANAGED_RULE_GROUP"))
    return F.when(from_group, F.array_max(F.transform(groups, lambda g, i: F.when(_blocks(g), i))))


def _named(group: Column, rule_id: Column) -> Column:
    return F.concat(rule_group_name(group["ruleGroupId"]), F.lit("/"), F.coalesce(rule_id, F.lit("")))


def effective_rule(groups: Column, index: Column, rule_id: Column) -> Column:
    group = F.get(groups, index)
    return present(F.when(index.isNotNull(), _named(group, group["terminatingRule"]["ruleId"])).otherwise(rule_id))


def effective_group(groups: Column, index: Column) -> Column:
    return F.when(index.isNotNull(), present(rule_group_name(F.get(groups, index)["ruleGroupId"])))


def count_rules(groups: Column, index: Column, top_level: Column) -> Column:
    """Rules that matched without deciding the request, in log order, once each."""

    def is_count(rule: Column) -> Column:
        return yes(F.lower(rule["action"]) == "count")

    def of_group(group: Column, i: Column) -> Column:
        overridden = F.when(
            _blocks(group) & (index.isNull() | (i != index)),
            F.array(_named(group, group["terminatingRule"]["ruleId"])),
        )
        counted = F.transform(
            F.filter(group["nonTerminatingMatchingRules"], is_count), lambda r: _named(group, r["ruleId"])
        )
        excluded = F.transform(
            F.filter(group["excludedRules"], lambda r: yes(r["ruleId"] != "")), lambda r: _named(group, r["ruleId"])
        )
        return F.concat(_list(overridden), _list(counted), _list(excluded))

    grouped = F.flatten(F.transform(groups, of_group))
    single = F.transform(F.filter(top_level, is_count), lambda r: F.coalesce(r["ruleId"], F.lit("")))
    return F.array_distinct(F.concat(_list(grouped), _list(single)))


def rate_rule(rule_type: Column, rule_id: Column) -> Column:
    return F.when(rule_type == "RATE_BASED", present(rule_id))


def challenge_failed(*responses: Column) -> Column:
    """Any challenge with a failure reason, or a response code outside 2xx."""
    out = F.lit(False)
    for r in responses:
        code = F.coalesce(r["responseCode"], F.lit(0))
        out = out | yes(r["failureReason"] != "") | ((code != 0) & ~code.between(200, 299))
    return out


def _first_with_prefix(items: Column, prefixes: tuple[str, ...]) -> Column:
    def hit(x: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.startswith(x, F.lit(p))
        return out

    return F.get(F.filter(items, hit), F.lit(0))


def exploit_match(action: Column, rules: Column, labels: Column) -> Column:
    """COUNT rule or label showing that an allowed request carried an exploit."""
    return F.when(
        action == "ALLOW",
        F.coalesce(_first_with_prefix(rules, EXPLOIT_GROUPS), _first_with_prefix(labels, EXPLOIT_LABELS)),
    )


# Object access -------------------------------------------------------------


def principal(requester: Column) -> Column:
    return F.coalesce(requester, F.lit(ANONYMOUS))


def object_status_class(status: Column) -> Column:
    """Nxx for 200-599, else ``other``."""
    return F.when(
        status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    ).otherwise("other")


def object_success(status: Column) -> Column:
    return yes(status.between(200, 299))


def object_error(status: Column, error_code: Column) -> Column:
    return yes(status >= 400) | error_code.isNotNull()


def object_denied(status: Column, error_code: Column) -> Column:
    return yes(status == 403) | yes(error_code == "AccessDenied")


def object_write(operation: Column) -> Column:
    return yes(operation.isin(*OBJECT_WRITES))


def object_delete(operation: Column) -> Column:
    return yes(operation.isin(*OBJECT_DELETES))


def object_multi_delete(operation: Column) -> Column:
    return yes(operation == OBJECT_MULTI_DELETE)


def object_read(operation: Column) -> Column:
    return yes(operation.isin(*OBJECT_READS))


def object_access_change(operation: Column) -> Column:
    return yes(operation.isin(*OBJECT_ACCESS_CHANGES))


def object_weak_tls(tls_version: Column) -> Column:
    return yes(tls_version.isin(*OBJECT_WEAK_TLS))


def object_sigv2(sig_version: Column) -> Column:
    return yes(sig_version == "SigV2")


def plain_http(raw_tls_token: Column, operation: Column) -> Column:
    """The record has a TLS field, it is ``-``, and the call is REST."""
    return yes(raw_tls_token == "-") & yes(F.startswith(operation, F.lit("REST.")))


def tls_version(c: Column) -> Column:
    """``TLSV1.2`` becomes ``TLSv1.2``."""
    return F.regexp_replace(c, r"(?i)^tlsv(?=.)", "TLSv")


# Network flows -------------------------------------------------------------


def effective(pkt_addr: Column, addr: Column) -> Column:
    """Real endpoint: the packet address when the format has it."""
    return F.coalesce(pkt_addr, addr)


def protocol_name(protocol: Column) -> Column:
    named = None
    for number, name in PROTOCOL_NAMES.items():
        test = protocol == number
        named = F.when(test, name) if named is None else named.when(test, name)
    return named.otherwise(protocol.cast("string"))


def service_label(protocol: Column, dst_port: Column) -> Column:
    """``443/tcp``; ICMP and flows without a port are named by protocol alone."""
    name = protocol_name(protocol)
    no_port = yes(protocol.isin(1, 58)) | dst_port.isNull()
    return F.when(no_port, name).otherwise(F.concat_ws("/", dst_port.cast("string"), name))


def initiator(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """The source looks like the side that opened the conversation."""
    return (
        yes(protocol.isin(1, 58))
        | src_port.isNull()
        | dst_port.isNull()
        | yes(src_port > dst_port)
    )


def conn_attempt(protocol: Column, tcp_flags: Column) -> Column:
    """Not TCP, flags unknown, or SYN without ACK."""
    return ~yes(protocol == 6) | tcp_flags.isNull() | yes(tcp_flags.bitwiseAND(F.lit(0x12)) == 0x02)


# Tones ---------------------------------------------------------------------


def value_tone(v: Column) -> Column:
    """Colour class of a ranked value: crit, warn, ok, info or NULL."""
    text = F.trim(v)
    spaced = F.contains(text, F.lit(" "))
    proto = F.when(spaced, F.regexp_extract(text, r"(?s)^[^ ]* (.*)$", 1)).otherwise(text)
    listener = F.when(spaced, F.substring_index(text, " ", 1)).otherwise("")
    digit = F.substring(text, 1, 1)
    return (
        F.when(
            F.rlike(text, F.lit("^[1-5][0-9]{2}$")),
            F.when(digit == "5", "crit").when(digit == "4", "warn").when(digit == "2", "ok").otherwise("info"),
        )
        .when(proto.isin(*LB_WEAK_TLS), "crit")
        .when((proto == "no TLS") & (listener == "443"), "crit")
        .when(proto == "unknown", "warn")
        .when(proto == "TLSv1.3", "ok")
        .when(F.startswith(text, F.lit("Failed")), "crit")
        .when(text.isin("Success", "ALLOW", "ACCEPT"), "ok")
        .when(text.isin("BLOCK", "REJECT"), "crit")
        .when(text.isin("CAPTCHA", "CHALLENGE", "SigV2"), "warn")
        .when(text == "COUNT", "info")
    )


def action_tone(v: Column) -> Column:
    """Tone of a flow value: only ACCEPT and REJECT are coloured."""
    return F.when(v == "ACCEPT", "ok").when(v == "REJECT", "crit")


def severity_tone(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "crit").when(severity == "MEDIUM", "warn").otherwise("info")


def threshold_tone(v: Column, warn: float, crit: float) -> Column:
    return F.when(v >= crit, "crit").when(v >= warn, "warn").otherwise("ok")


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
