"""Security findings.

Per-record rules (audit) are one pass: every rule is a condition and a struct,
the array of hits is unfolded. Aggregate rules fold the records into *facts*
first, ``(tag, actor, extra, item)`` with a count, byte sum and first time, in
one scan for all rules of the family, then judge one row per actor. Facts of a
hot actor are spread by item, so no task holds a whole actor; the only lists
ever collected are cut to a few entries before they are collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions.text import binary_size, gibibytes
from logloom.operators import audit, flows, objects, waf
from logloom.schema import FINDING_COLUMNS, SEVERITIES, SEVERITY_RANK, parse_severity
from logloom.session import shared_dir

# Rule thresholds.
BLOCK_THRESHOLD = 100
DENIED_THRESHOLD = 100
DELETE_THRESHOLD = 1000
OBJECT_EGRESS_BYTES = 10 << 30
SCAN_PORTS = 25
SWEEP_HOSTS = 50
FLOW_EGRESS_BYTES = 1 << 30


# Per-record rules ----------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A per-record rule: plain column expressions, so a custom rule stays in generated code."""

    id: str
    severity: str
    title: str
    when: Column
    detail: Column


# Fixed values of the audit rules.
DENIED_CODES = ("AccessDenied", "AccessDeniedException", "UnauthorizedOperation", "Client.UnauthorizedOperation")
IAM_CHANGE_VERBS = (
    "Create", "Delete", "Put", "Update", "Attach", "Detach", "Add", "Remove", "Set", "Tag", "Untag", "Change",
    "Enable", "Disable", "Upload",
)
TRAIL_CHANGES = ("StopLogging", "DeleteTrail", "UpdateTrail", "PutEventSelectors", "DeleteEventDataStore")
BUCKET_EXPOSURES = (
    "PutBucketPolicy", "DeleteBucketPolicy", "PutBucketAcl", "PutBucketPublicAccessBlock",
    "DeletePublicAccessBlock", "PutAccountPublicAccessBlock",
)
KEY_DESTRUCTIONS = ("DisableKey", "ScheduleKeyDeletion", "DeleteAlias", "DisableKeyRotation")


def audit_rules() -> list[Rule]:
    name, service, ip = F.col("event_name"), audit.service(), F.coalesce("source_ip", F.lit(""))
    region, identity = F.coalesce("aws_region", F.lit("")), F.col("user_identity")
    params = F.col("request_parameters")
    login = name == "ConsoleLogin"

    def param(field: str) -> Column:
        return F.coalesce(d.json_text(params, field), F.lit(""))

    def sentence(*parts: Column | str) -> Column:
        return F.trim(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]))

    def outcome(expected: str) -> Column:
        return login & (d.json_text(F.col("response_elements"), "ConsoleLogin") == expected)

    return [
        Rule(
            "root-usage", "CRITICAL", "Root account activity",
            (identity["type"] == "Root") & identity["invoked_by"].isNull(),
            sentence("Root account used for ", name, " in ", region),
        ),
        Rule(
            "console-no-mfa", "HIGH", "Console login without MFA",
            outcome("Success") & (d.json_text(F.col("additional_event_data"), "MFAUsed") == "No"),
            sentence("ConsoleLogin succeeded without MFA from ", ip),
        ),
        Rule(
            "console-login-failed", "MEDIUM", "Failed console login",
            outcome("Failure"), sentence("Failed console login from ", ip),
        ),
        Rule(
            "access-denied", "LOW", "Authorization failure",
            F.col("error_code").isin(*DENIED_CODES),
            sentence(F.col("error_code"), " denied on ", name, " (", service, ")"),
        ),
        Rule(
            "iam-mutation", "MEDIUM", "IAM configuration changed",
            (service == "iam") & F.rlike(name, F.lit("^(?:" + "|".join(IAM_CHANGE_VERBS) + ")")),
            sentence(name, " in ", region),
        ),
        Rule(
            "access-key-created", "HIGH", "Access key created",
            (service == "iam") & (name == "CreateAccessKey"),
            sentence(
                "Long-lived access key created for ",
                F.coalesce(F.nullif(d.json_text(params, "userName"), F.lit("")), F.lit("the calling identity")),
            ),
        ),
        Rule(
            "cloudtrail-tamper", "CRITICAL", "CloudTrail configuration changed",
            (service == "cloudtrail") & name.isin(*TRAIL_CHANGES), sentence(name, " on trail ", param("name")),
        ),
        Rule(
            "s3-exposure", "HIGH", "S3 bucket exposure setting changed",
            (service == "s3") & name.isin(*BUCKET_EXPOSURES), sentence(name, " on bucket ", param("bucketName")),
        ),
        Rule(
            "sg-open-ingress", "HIGH", "Security group opened to the internet",
            (service == "ec2")
            & (name == "AuthorizeSecurityGroupIngress")
            & (F.contains(params, F.lit("0.0.0.0/0")) | F.contains(params, F.lit("::/0"))),
            F.lit("AuthorizeSecurityGroupIngress with 0.0.0.0/0"),
        ),
        Rule(
            "kms-destruction", "HIGH", "KMS key availability reduced",
            (service == "kms") & name.isin(*KEY_DESTRUCTIONS), sentence(name, " on key ", param("keyId")),
        ),
    ]


def audit_findings(events: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Every rule hit of every event, in one pass; a given rule list replaces the built-in one."""
    rules = audit_rules() if rules is None else rules
    hits = [
        F.when(
            rule.when,
            F.struct(
                F.lit(rule.id).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                F.lit(SEVERITY_RANK[rule.severity]).alias("severity_rank"),
                F.lit(rule.title).alias("title"),
                rule.detail.alias("detail"),
            ),
        )
        for rule in rules
    ]
    fields = ["rule", "severity", "severity_rank", "title", "detail"]
    return (
        events.select(
            audit.actor().alias("actor"),
            F.col("recipient_account_id").alias("account"),
            F.col("aws_region").alias("region"),
            "event_id",
            F.col("event_time").alias("time"),
            F.lit(1).cast("bigint").alias("n"),
            F.explode(F.array(*hits)).alias("hit"),
        )
        .where(F.col("hit").isNotNull())
        .select("*", *[F.col(f"hit.{f}").alias(f) for f in fields])
        .select(*FINDING_COLUMNS)
    )


# Facts ---------------------------------------------------------------------


def _fact(tag: str, actor: Column, extra: Column | None = None, item: Column | None = None,
          bytes_: Column | None = None) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"),
        actor.cast("string").alias("actor"),
        (F.lit(None) if extra is None else extra).cast("string").alias("extra"),
        (F.lit(None) if item is None else item).cast("string").alias("item"),
        (F.lit(0) if bytes_ is None else bytes_).cast("bigint").alias("bytes"),
    )


def _fold(df: DataFrame, facts: Sequence[Column], ts: str, many: Column | None = None, window: bool = False) -> DataFrame:
    """Facts of all records, folded by (tag, actor, extra, item) in one scan.

    Conditions that do not hold leave a NULL entry, dropped after the unfolding:
    an array filter would evaluate every condition outside generated code. With
    ``window``, every record is a fact of the window too.
    """
    entries = F.array(*facts, *([_fact("window", F.lit(""))] if window else []))
    if many is not None:
        entries = F.concat(entries, many)
    return (
        df.select(F.col(ts).alias("ts"), F.explode(entries).alias("f"))
        .where(F.col("f").isNotNull())
        .select("ts", "f.*")
        .groupBy("tag", "actor", "extra", "item")
        .agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first"))
    )


def _stored(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folded facts as a table in the shared folder, and the window's first time from it.

    Totals, leaders and the first time are then read from this small table; the log is scanned once.
    """
    spark = facts.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/facts-{uuid.uuid4().hex}"
    facts.write.parquet(path)
    table = spark.read.schema(facts.schema).parquet(path)
    return table, table.where(F.col("tag") == "window").agg(F.min("first"))


def leading_items(facts: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, text: Column) -> DataFrame:
    """``key (n), key (n)`` of the leading items per group; cut to ``n`` before they are collected."""
    w = Window.partitionBy(*keys).orderBy(*order)
    entry = F.struct(F.col("place"), text.alias("text"))
    return (
        facts.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("leaders"))
    )


def by_count() -> list[Column]:
    return [F.desc("n"), F.asc("item")]


def counted_item() -> Column:
    return F.concat("item", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))


def _findings(judged: DataFrame, default_time: Column) -> DataFrame:
    """Shape judged rows into the findings table; an untimed finding takes the window's first record time."""
    none = F.lit(None).cast("string")
    return (
        judged.withColumn("time", F.coalesce("time", default_time))
        .withColumn("severity_rank", _rank_of(F.col("severity")))
        .withColumn("account", none)
        .withColumn("region", none)
        .withColumn("event_id", none)
        .select(*FINDING_COLUMNS)
    )


def _rank_of(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], SEVERITY_RANK[SEVERITIES[0]])
    for name in SEVERITIES[1:]:
        out = out.when(severity == name, SEVERITY_RANK[name])
    return out


def _verdict(rule: str, severity: str, title: str, detail: Column, n: Column, time: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(title).alias("title"),
        detail.alias("detail"),
        n.cast("bigint").alias("n"),
        (F.lit(None) if time is None else time).alias("time"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _judge(rows: DataFrame, verdicts: Mapping[str, tuple[Column, Column]], names: set[str] | None) -> DataFrame:
    """Apply the wanted ``rule -> (condition, verdict)`` entries to one row per actor."""
    chosen = [F.when(test, v) for rule, (test, v) in verdicts.items() if _wanted(names, rule)]
    judged = rows.select("actor", F.explode(F.array(*chosen)).alias("v"))
    return judged.where(F.col("v").isNotNull()).select("actor", "v.*")


def _wanted(names: Iterable[str] | None, rule: str) -> bool:
    return names is None or rule in names


# Web-firewall rules ---------------------------------------------------------


def waf_findings(df: DataFrame, block_threshold: int = BLOCK_THRESHOLD,
                 rules: Iterable[str] | None = None) -> DataFrame:
    """Findings over web-firewall requests; ``rules`` limits the work to some rule ids."""
    facts, first = _stored(waf_facts(df, window=True))
    return waf_rules(
        clients=waf.client_stats(df), facts=facts, first=first, block_threshold=block_threshold, rules=rules,
    )


def waf_facts(df: DataFrame, window: bool = False) -> DataFrame:
    """Rate-limited, COUNT-rule, exploit and oversize facts."""
    counted = F.transform(
        F.coalesce("count_rules", F.array().cast("array<string>")), lambda r: _fact("count", r)
    )
    match = waf.exploit()
    facts = [
        F.when(F.col("rate_rule").isNotNull(), _fact("rate", F.col("rate_rule"), item=F.col("client_ip"))),
        F.when(F.col("oversize"), _fact("oversize", F.lit(""))),
        F.when(match.isNotNull(), _fact("exploit", F.coalesce("client_ip", F.lit("")), item=match)),
    ]
    return _fold(df, facts, "ts", counted, window)


def waf_rules(clients: DataFrame, facts: DataFrame, first: DataFrame, block_threshold: int = BLOCK_THRESHOLD,
              rules: Iterable[str] | None = None) -> DataFrame:
    """Judge aggregated clients and facts (of one scan, or merged from several)."""
    names = None if rules is None else set(rules)
    challenge_min = max(1, block_threshold // 10)
    blocks, allows, fails, exploits = (F.col(c) for c in ("blocks", "allows", "challenge_fails", "exploits"))
    named = F.col("actor") != ""
    listed = facts.where(F.col("item").isNotNull() & F.col("tag").isin("rate", "exploit"))
    leaders = leading_items(
        listed, ["tag", "actor"], by_count(), 5,
        F.when(F.col("tag") == "rate", counted_item()).when(F.col("place") <= 3, F.col("item")),
    )
    per_client = {
        "waf-attacker-allowed": (
            named & (blocks >= block_threshold) & (allows > 0),
            _verdict("waf-attacker-allowed", "HIGH", "Blocked client also allowed",
                     _text(blocks, " blocked and ", allows, " allowed requests"), blocks),
        ),
        "waf-persistent-blocked-ip": (
            named & (blocks >= block_threshold) & (allows == 0),
            _verdict("waf-persistent-blocked-ip", "MEDIUM", "Persistent blocked client",
                     _text(blocks, " blocked requests"), blocks),
        ),
        "waf-challenge-failures": (
            named & (fails >= challenge_min),
            _verdict("waf-challenge-failures", "LOW", "Repeated CAPTCHA or challenge failures",
                     _text(fails, " failed CAPTCHA or challenge responses"), fails),
        ),
    }
    with_exploits = {
        "waf-exploit-allowed": (
            exploits > 0,
            _verdict("waf-exploit-allowed", "CRITICAL", "Exploit payload allowed",
                     _text(exploits, " allowed requests matched COUNT-mode exploit rules (",
                           F.coalesce("leaders", F.lit("")), "); first at ", F.coalesce("exploit_uri", F.lit(""))),
                     exploits, F.col("exploit_first")),
        ),
    }
    n, with_item = F.col("n"), F.col("n_with_item")
    per_fact = {
        "waf-rate-limited": (
            F.col("tag") == "rate",
            _verdict("waf-rate-limited", "HIGH", "Rate limit triggered",
                     _text(with_item, " requests limited; top clients: ", F.coalesce("leaders", F.lit(""))),
                     with_item),
        ),
    }
    plain_facts = {
        "waf-count-rule": (
            F.col("tag") == "count",
            _verdict("waf-count-rule", "MEDIUM", "COUNT rule would block",
                     _text(n, " requests matched this rule in COUNT mode"), n),
        ),
        "waf-oversize": (
            F.col("tag") == "oversize",
            _verdict("waf-oversize", "MEDIUM", "Request fields over the inspection limit",
                     _text(n, " requests had a body, headers, or cookies larger than WAF inspects"), n),
        ),
    }
    parts = []
    actors = clients.withColumnRenamed("client", "actor")
    if _any_wanted(names, with_exploits):
        actors = actors.join(leaders.where(F.col("tag") == "exploit").drop("tag"), "actor", "left")
        per_client |= with_exploits
    if _any_wanted(names, per_client):
        parts.append(_judge(actors, per_client, names))
    tags = [t for t, rule in (("rate", "waf-rate-limited"), ("count", "waf-count-rule"), ("oversize", "waf-oversize"))
            if _wanted(names, rule)]
    if tags:
        totals = facts.where(F.col("tag").isin(*tags)).groupBy("tag", "actor").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("item").isNotNull(), n)), F.lit(0)).alias("n_with_item")
        )
        if "rate" in tags:
            totals = totals.join(leaders.where(F.col("tag") == "rate"), ["tag", "actor"], "left")
            plain_facts |= per_fact
        parts.append(_judge(totals, plain_facts, names))
    return _findings(_union(parts), first.scalar())


def _any_wanted(names: set[str] | None, rules: Iterable[str]) -> bool:
    return any(_wanted(names, r) for r in rules)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Object-access rules --------------------------------------------------------


def object_findings(df: DataFrame, denied_threshold: int = DENIED_THRESHOLD,
                    delete_threshold: int = DELETE_THRESHOLD, egress_bytes: int = OBJECT_EGRESS_BYTES,
                    rules: Iterable[str] | None = None) -> DataFrame:
    """Findings over object-access requests."""
    facts, first = _stored(object_facts(df, window=True))
    return object_rules(
        facts=facts, changes=objects.access_changes(df), first=first,
        denied_threshold=denied_threshold, delete_threshold=delete_threshold, egress_bytes=egress_bytes, rules=rules,
    )


def object_facts(df: DataFrame, window: bool = False) -> DataFrame:
    ip, req, who = F.col("remote_ip"), F.col("requester"), objects.principal()
    sent = F.col("bytes_sent")

    def anonymous(tag: str, condition: Column) -> list[Column]:
        bucket = F.col("bucket")
        return [
            F.when(condition, _fact(tag, bucket, F.lit("all"))),
            F.when(condition, _fact(tag, bucket, F.lit("op"), F.col("operation"))),
            F.when(condition & ip.isNotNull(), _fact(tag, bucket, F.lit("ip"), ip)),
            F.when(condition & F.col("key").isNotNull(), _fact(tag, bucket, F.lit("key"), F.col("key"))),
        ]

    facts = [
        *anonymous("anon-write", objects.anon_write()),
        *anonymous("anon-read", objects.anon_read()),
        F.when(objects.denied() & ip.isNotNull(), _fact("denied", ip, F.lit("IP"))),
        F.when(objects.denied() & req.isNotNull(), _fact("denied", req, F.lit("requester"))),
        F.when(objects.success() & d.object_delete(F.col("operation")), _fact("delete", who)),
        F.when((sent > 0) & ip.isNotNull(), _fact("egress", ip, F.lit("IP"), bytes_=sent)),
        F.when((sent > 0) & req.isNotNull(), _fact("egress", req, F.lit("requester"), bytes_=sent)),
        F.when(d.object_weak_tls(F.col("tls_version")), _fact("weak-tls", who)),
        F.when(d.yes(F.col("plain_http")), _fact("plain-http", who)),
        F.when(d.object_sigv2(F.col("sig_version")), _fact("sigv2", who)),
    ]
    return _fold(df, facts, "ts", window=window)


def object_rules(facts: DataFrame, changes: DataFrame, first: DataFrame, denied_threshold: int = DENIED_THRESHOLD,
                 delete_threshold: int = DELETE_THRESHOLD, egress_bytes: int = OBJECT_EGRESS_BYTES,
                 rules: Iterable[str] | None = None) -> DataFrame:
    names = None if rules is None else set(rules)
    n, sent, extra = F.col("n"), F.col("bytes"), F.col("extra")
    parts = []

    def shown(kind: str) -> Column:
        return F.coalesce(F.col(f"top_{kind}"), F.lit("-"))

    def anonymous(rule: str, severity: str, title: str, phrase: str) -> Column:
        return _verdict(rule, severity, title,
                        _text(n, phrase, shown("op"), ") from ", shown("ip"), "; keys ", shown("key")), n,
                        F.col("first"))

    tag = F.col("tag")
    with_leaders = {
        "s3-anonymous-write": (
            tag == "anon-write",
            anonymous("s3-anonymous-write", "CRITICAL", "Anonymous write or delete succeeded",
                      " anonymous write or delete requests succeeded ("),
        ),
        "s3-anonymous-read": (
            tag == "anon-read",
            anonymous("s3-anonymous-read", "HIGH", "Anonymous read succeeded", " anonymous reads succeeded ("),
        ),
    }
    verdicts = {
        "s3-access-denied-burst": (
            (tag == "denied") & (n >= denied_threshold),
            _verdict("s3-access-denied-burst", "HIGH", "Burst of denied requests",
                     _text(n, " denied requests (403 or AccessDenied) from this ", extra), n),
        ),
        "s3-mass-delete": (
            (tag == "delete") & (n >= delete_threshold),
            _verdict("s3-mass-delete", "HIGH", "Mass object deletion", _text(n, " objects deleted"), n),
        ),
        "s3-large-egress": (
            (tag == "egress") & (sent >= egress_bytes),
            _verdict("s3-large-egress", "MEDIUM", "Large data egress",
                     _text(gibibytes(sent), " sent to this ", extra), sent),
        ),
        "s3-weak-tls": (
            tag == "weak-tls",
            _verdict("s3-weak-tls", "LOW", "TLS below 1.2", _text(n, " requests used TLS below 1.2"), n),
        ),
        "s3-plain-http": (
            tag == "plain-http",
            _verdict("s3-plain-http", "LOW", "Requests over plain HTTP",
                     _text(n, " REST requests used plain HTTP"), n),
        ),
        "s3-sigv2": (
            tag == "sigv2",
            _verdict("s3-sigv2", "LOW", "Signature Version 2 requests",
                     _text(n, " requests were signed with Signature Version 2"), n),
        ),
    }
    rule_tags = {
        "s3-anonymous-write": "anon-write", "s3-anonymous-read": "anon-read", "s3-access-denied-burst": "denied",
        "s3-mass-delete": "delete", "s3-large-egress": "egress", "s3-weak-tls": "weak-tls",
        "s3-plain-http": "plain-http", "s3-sigv2": "sigv2",
    }
    tags = [t for rule, t in rule_tags.items() if _wanted(names, rule)]
    if tags:
        totals = facts.where(tag.isin(*tags) & F.col("item").isNull())
        if _any_wanted(names, with_leaders):
            listed = facts.where(F.col("item").isNotNull() & tag.isin("anon-write", "anon-read"))
            top = leading_items(listed, ["tag", "actor", "extra"], by_count(), 3, counted_item())
            by_kind = top.groupBy("tag", "actor").agg(
                *[F.max(F.when(extra == kind, F.col("leaders"))).alias(f"top_{kind}") for kind in ("op", "ip", "key")]
            )
            totals = totals.join(by_kind, ["tag", "actor"], "left")
            verdicts |= with_leaders
        parts.append(_judge(totals, verdicts, names))
    if _wanted(names, "s3-access-change"):
        target = F.concat_ws("/", "bucket", "key")
        verdict = _verdict("s3-access-change", "MEDIUM", "Bucket access configuration changed",
                           _text(F.col("operation"), " on ", target, " from ", F.coalesce("remote_ip", F.lit(""))),
                           F.lit(1), F.col("ts"))
        rows = changes.withColumn("actor", F.col("principal"))
        parts.append(_judge(rows, {"s3-access-change": (F.lit(True), verdict)}, names))
    return _findings(_union(parts), first.scalar())


# Network-flow rules ---------------------------------------------------------


def flow_findings(df: DataFrame, scan_ports: int = SCAN_PORTS, sweep_hosts: int = SWEEP_HOSTS,
                  egress_bytes: int = FLOW_EGRESS_BYTES, rules: Iterable[str] | None = None) -> DataFrame:
    """Findings over network flows (status rows are skipped)."""
    only = flows.only_flows(df)
    facts, first = _stored(flow_facts(only, rules, window=True))
    return flow_rules(
        facts=facts, first=first, scan_ports=scan_ports, sweep_hosts=sweep_hosts, egress_bytes=egress_bytes, rules=rules,
    )


def flow_facts(df: DataFrame, rules: Iterable[str] | None = None, window: bool = False) -> DataFrame:
    """Scan, exposure, sweep, egress and legacy facts. Each flow is classified once, before the rules look at it."""
    names = None if rules is None else set(rules)
    classified = flows.classified(df)
    src, dst, size = F.col("source"), F.col("destination"), F.col("bytes")
    by_rule = {
        # Every reject of the source, with the port only where it is a scan attempt.
        "vpc-port-scan": [
            F.when(F.col("is_reject") & src.isNotNull(),
                   _fact("scan", src, item=F.when(F.col("is_scan"), F.col("dst_port"))))
        ],
        "vpc-sensitive-port-exposed": [
            F.when(F.col("is_exposed"), _fact("exposed", F.col("exposed_service"), item=src, bytes_=size))
        ],
        "vpc-host-sweep": [F.when(F.col("is_sweep"), _fact("sweep", src, item=dst))],
        "vpc-large-egress": [F.when(F.col("is_egress") & (size > 0), _fact("egress", src, bytes_=size))],
        "vpc-legacy-protocol": [
            F.when(F.col("is_legacy_in"), _fact("legacy-in", dst, F.col("service"))),
            F.when(F.col("is_legacy_out"), _fact("legacy-out", src, F.col("service"))),
        ],
    }
    facts = [f for rule, fs in by_rule.items() if _wanted(names, rule) for f in fs]
    return _fold(classified, facts, "start", window=window)


def flow_rules(facts: DataFrame, first: DataFrame, scan_ports: int = SCAN_PORTS, sweep_hosts: int = SWEEP_HOSTS,
               egress_bytes: int = FLOW_EGRESS_BYTES, rules: Iterable[str] | None = None) -> DataFrame:
    """Judge flow facts. Counts of scans and sweeps stop at their threshold, as "or more"."""
    names = None if rules is None else set(rules)
    tag, n, sent, items, extra = (F.col(c) for c in ("tag", "n", "bytes", "items", "extra"))
    per_actor = facts.groupBy("tag", "actor", "extra").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"),
        F.count("item").alias("items"),
    )
    listed = facts.where(F.col("item").isNotNull() & tag.isin("scan", "exposed"))
    # Scans list their smallest ports, exposed services their busiest sources.
    order = (
        F.asc(F.when(tag == "scan", F.col("item").try_cast("int")).otherwise(-n)),
        F.asc("item"),
    )
    leaders = leading_items(
        listed, ["tag", "actor"], order, 10,
        F.when(tag == "scan", F.col("item")).when(F.col("place") <= 5, counted_item()),
    )
    ports, hosts = F.lit(scan_ports), F.lit(sweep_hosts)
    judged = {
        "vpc-port-scan": (
            (tag == "scan") & (items >= scan_ports),
            _verdict("vpc-port-scan", "HIGH", "Port scan from a public address",
                     _text("rejected connection attempts to ", ports, " or more distinct ports (sample: ",
                           F.col("leaders"), "); ", n, " rejected flows"), ports),
        ),
        "vpc-sensitive-port-exposed": (
            tag == "exposed",
            _verdict("vpc-sensitive-port-exposed", "HIGH", "Sensitive port reachable from the internet",
                     _text(n, " accepted flows, ", binary_size(sent), ", from ", items, " public sources; top: ",
                           F.col("leaders")), n, F.col("first")),
        ),
        "vpc-host-sweep": (
            (tag == "sweep") & (items >= sweep_hosts),
            _verdict("vpc-host-sweep", "MEDIUM", "Host sweep",
                     _text("started flows to ", hosts, " or more distinct private addresses"), hosts),
        ),
        "vpc-large-egress": (
            (tag == "egress") & (sent >= egress_bytes),
            _verdict("vpc-large-egress", "MEDIUM", "Large egress to public addresses",
                     _text("sent ", binary_size(sent), " in accepted flows it started to public addresses (threshold ",
                           binary_size(F.lit(egress_bytes)), ")"), sent),
        ),
        "vpc-legacy-protocol": (
            tag.isin("legacy-in", "legacy-out"),
            _verdict("vpc-legacy-protocol", "LOW", "Legacy protocol in use",
                     _text(n, " accepted flows on ", extra,
                           F.when(tag == "legacy-in", " inbound from").otherwise(" outbound to"), " public addresses"),
                     n),
        ),
    }
    chosen = {rule: v for rule, v in judged.items() if _wanted(names, rule)}
    keep = F.lit(False)
    for test, _ in chosen.values():
        keep = keep | test
    hits = per_actor.where(keep)
    if {"vpc-port-scan", "vpc-sensitive-port-exposed"} & set(chosen):
        hits = hits.join(leaders, ["tag", "actor"], "left")
    else:
        hits = hits.withColumn("leaders", F.lit(None).cast("string"))
    return _findings(_judge(hits, chosen, names), first.scalar())


# Order, caps and verdicts ---------------------------------------------------


def audit_order() -> list[Column]:
    return [F.desc("severity_rank"), F.asc("time"), F.asc("event_id"), F.asc("rule")]


def aggregate_order() -> list[Column]:
    return [F.desc("severity_rank"), F.desc("n"), F.asc("actor"), F.asc("rule"), F.asc("time"), F.asc("detail")]


def cap_audit(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """Most severe findings first, oldest first within a severity; all of them without a cap."""
    ordered = findings.orderBy(*audit_order())
    return ordered if cap is None else ordered.limit(cap)


def cap_aggregate(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """First ``cap`` findings in report order, and every CRITICAL one; all of them without a cap.

    CRITICAL sorts first, so the kept set is all CRITICAL findings and the
    others that the plain limit leaves.
    """
    if cap is None:
        return findings.orderBy(*aggregate_order())
    critical = F.col("severity") == "CRITICAL"
    rest = findings.orderBy(*aggregate_order()).limit(cap).where(~critical)
    return findings.where(critical).unionByName(rest)


def dropped_by(findings: DataFrame, kept: DataFrame) -> DataFrame:
    """How many findings a cap removed."""
    signed = findings.agg(F.count("*").alias("c")).unionByName(kept.agg((-F.count("*")).alias("c")))
    return signed.agg(F.sum("c").alias("dropped"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity, all four present."""
    spark = findings.sparkSession
    levels = spark.createDataFrame(list(SEVERITY_RANK.items()), "severity string, severity_rank int")
    counts = findings.groupBy("severity").agg(F.count("*").alias("c"))
    return levels.join(counts, "severity", "left").select(
        "severity", "severity_rank", F.coalesce("c", F.lit(0).cast("bigint")).alias("n")
    )


def max_severity(findings: DataFrame) -> DataFrame:
    """Highest severity and whether there is any finding."""
    return findings.agg(
        F.max_by("severity", "severity_rank").alias("severity"), (F.count("*") > 0).alias("any")
    )


def gate(findings: DataFrame, threshold: str, unreadable: int = 0) -> DataFrame:
    """0 clean, 1 a finding at or above the threshold, 2 input that could not be read (which wins)."""
    rank = SEVERITY_RANK[parse_severity(threshold)]
    hit = F.coalesce(F.max("severity_rank"), F.lit(-1)) >= rank
    return findings.agg(
        F.when(F.lit(unreadable > 0), 2).when(hit, 1).otherwise(0).alias("verdict")
    )
