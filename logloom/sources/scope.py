"""Where the logs of a time span lie, and which files are logs.

Paths are pruned before anything is listed: one glob names exactly the
accounts, regions and UTC days of the scope, so a bucket root is never walked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The service element of the delivery path.
AUDIT, LB, WAF, FLOWS = "CloudTrail", "elasticloadbalancing", "WAFLogs", "vpcflowlogs"


@dataclass(frozen=True)
class Scope:
    """Accounts x regions x UTC days (inclusive) under an optional base prefix and organisation."""

    accounts: Sequence[str]
    regions: Sequence[str]
    start: date
    end: date
    base_prefix: str = ""
    org_id: str = ""

    def days(self) -> list[date]:
        return [self.start + timedelta(days=i) for i in range((self.end - self.start).days + 1)]

    def widened(self) -> Scope:
        """One more delivery day: late records are filed under the next day and trimmed by record time."""
        return replace(self, end=self.end + timedelta(days=1))

    @property
    def empty(self) -> bool:
        return not (self.accounts and self.regions and self.days())


def window_scope(scope: Scope, since: datetime, until: datetime) -> Scope:
    """Scope days that cover the record window ``[since, until)``."""
    return replace(scope, start=since.date(), end=until.date()).widened()


def _join(*parts: str) -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts) if p.strip("/") or i == 0)


def _account_root(root: str, scope: Scope, account: str) -> str:
    return _join(root, scope.base_prefix, "AWSLogs", scope.org_id, account)


def scan_paths(root: str, scope: Scope, service: str) -> list[str]:
    """One folder per account, region and day, in that order."""
    if scope.empty:
        return []
    return [
        _join(_account_root(root, scope, account), service, region, f"{day:%Y/%m/%d}")
        for account in scope.accounts
        for region in scope.regions
        for day in scope.days()
    ]


def _either(items: Sequence[str]) -> str:
    return items[0] if len(items) == 1 else "{" + ",".join(items) + "}"


def scan_glob(root: str, scope: Scope, service: str, name: str = "", depth: int = 0) -> str | None:
    """The same folders as one glob; folders that do not exist are simply not matched.

    ``name`` is the extra level some services put before the date (``*`` for
    any); ``depth`` adds levels below the day.
    """
    if scope.empty:
        return None
    days = _either([f"{d:%Y/%m/%d}" for d in scope.days()])
    root_part = _account_root(root, scope, _either(list(scope.accounts)))
    return _join(root_part, service, _either(list(scope.regions)), name, days, *["*"] * depth)


def flat_glob(root: str, prefix: str, scope: Scope) -> str | None:
    """Flat layout: ``<prefix>YYYY-MM-DD-...`` file names; the prefix is used verbatim."""
    days = scope.days()
    if not days:
        return None
    return root.rstrip("/") + "/" + prefix.lstrip("/") + _either([f"{d:%Y-%m-%d}" for d in days]) + "-*"


def partitioned_glob(root: str, prefix: str, scope: Scope) -> str | None:
    """Partitioned object-log layout: ``<prefix><account>/<region>/<bucket>/YYYY/MM/DD/``."""
    if scope.empty:
        return None
    days = _either([f"{d:%Y/%m/%d}" for d in scope.days()])
    head = root.rstrip("/") + "/" + prefix.lstrip("/")
    return head + _join(_either(list(scope.accounts)), _either(list(scope.regions)), "*", days)


def hive_glob(root: str, scope: Scope) -> str | None:
    """Hive-style flow-log folders: ``aws-account-id=.../aws-service=.../aws-region=...``."""
    if scope.empty:
        return None
    head = _join(root, scope.base_prefix, "AWSLogs")
    days = _either([f"year={d:%Y}/month={d:%m}/day={d:%d}" for d in scope.days()])
    return _join(
        head, "aws-account-id=" + _either(list(scope.accounts)), f"aws-service={FLOWS}",
        "aws-region=" + _either(list(scope.regions)), days,
    )


# File predicates (on a path column) ----------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_audit_file(path: Column) -> Column:
    return (
        F.endswith(path, F.lit(".json.gz"))
        & F.contains(path, F.lit("_CloudTrail_"))
        & ~F.contains(path, F.lit("/CloudTrail-Digest/"))
    )


def lb_segment(path: Column) -> Column:
    """``app.<name>.<id>``, ``net.<name>.<id>`` or a Classic ``<name>`` from the file name."""
    return F.nullif(
        F.regexp_extract(base_name(path), r"_elasticloadbalancing_[^_]*_([^_]+)_", 1), F.lit("")
    )


def lb_kind(path: Column) -> Column:
    seg = lb_segment(path)
    return F.when(F.startswith(seg, F.lit("app.")), "alb").when(F.startswith(seg, F.lit("net.")), "nlb").when(
        seg.isNotNull(), "classic"
    )


def lb_name(path: Column) -> Column:
    seg = lb_segment(path)
    return F.when(
        F.rlike(seg, F.lit(r"^(?:app|net)\.")), F.regexp_extract(seg, r"^(?:app|net)\.([^.]*)", 1)
    ).otherwise(seg)


def is_conn_file(path: Column) -> Column:
    return F.startswith(base_name(path), F.lit("conn_log_"))


def is_lb_file(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\.log(?:\.gz)?$")) & lb_segment(path).isNotNull()


def lb_file_filter(path: Column, names: Sequence[str] = (), kinds: Sequence[str] = ()) -> Column:
    """Load-balancer logs of some kinds and of balancers whose name contains any given text."""
    out = is_lb_file(path)
    if kinds:
        out = out & lb_kind(path).isin(*kinds)
    return out & contains_any(lb_name(path), names)


def is_waf_file(path: Column) -> Column:
    return F.endswith(path, F.lit(".gz"))


def is_object_file(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}-[0-9A-Za-z]+$"))


def is_flow_file(path: Column) -> Column:
    name = base_name(path)
    return F.contains(name, F.lit("_vpcflowlogs_")) & F.rlike(name, F.lit(r"\.(?:log\.gz|parquet)$"))


def contains_any(c: Column, wanted: Sequence[str]) -> Column:
    """Contains any of the texts in any case; no text keeps everything."""
    needles = [w.strip().lower() for w in wanted if w.strip()]
    if not needles:
        return F.lit(True)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(F.lower(c), F.lit(n))
    return out


def path_part(path: Column, service_pattern: str) -> Column:
    """The folder level right before the date, such as an ACL or bucket name."""
    return F.nullif(F.regexp_extract(path, service_pattern + r"([^/]+)/\d{4}/\d{2}/\d{2}/", 1), F.lit(""))


ACL_LEVEL = rf"/{WAF}/[^/]+/"
BUCKET_LEVEL = r"/\d{12}/[^/]+/"


def discover(files: DataFrame, level: str, wanted: Sequence[str] = (), path: str = "file") -> DataFrame:
    """Sorted names found at a folder level that contain any given text: ``(name)``."""
    name = path_part(F.col(path), level)
    return (
        files.select(name.alias("name")).where(F.col("name").isNotNull() & contains_any(F.col("name"), wanted))
        .distinct()
        .orderBy("name")
    )


def parse_kind(text: str) -> str:
    """``alb``, ``nlb`` or ``classic`` from its usual names."""
    kinds = {
        "alb": "alb", "app": "alb", "application": "alb", "nlb": "nlb", "net": "nlb", "network": "nlb",
        "classic": "classic", "elb": "classic", "clb": "classic",
    }
    try:
        return kinds[text.strip().lower()]
    except KeyError:
        raise ValueError(f"no load balancer kind is named {text!r}; known are alb, nlb and classic") from None
