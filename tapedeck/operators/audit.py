"""Audit, lineage and performance analytics over ordinary tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- chains ------------------------------------------------------------------------------------


def broken_links(events: DataFrame, *, sequence: str, partition: list[str], hash_: str = "hash", previous: str = "previous_hash") -> DataFrame:
    """Events whose ``previous`` isn't the hash of the event before, in each partition's order."""
    w = Window.partitionBy(*partition).orderBy(sequence)
    return events.withColumn("expected", F.lag(hash_).over(w)).where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col(previous)))


def chain_hash(content: Column, previous: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), F.coalesce(previous, F.lit("")).cast("binary")), 256)


def backward_in_time(events: DataFrame, *, sequence: str, ts: str, partition: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(sequence)
    return events.withColumn("before", F.lag(ts).over(w)).where(F.col(ts) < F.col("before"))


def broken_lineage(steps: DataFrame, *, sequence: str, partition: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """Steps whose source isn't the target of the step before."""
    w = Window.partitionBy(*partition).orderBy(sequence)
    return steps.withColumn("before", F.lag(target).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(source)))


def threshold_event(events: DataFrame, n: int, *, key: str, order: list[str]) -> DataFrame:
    """The event that fires a monitor of ``n``: the one after the n-th, for each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") == n + 1).drop("_r")


# --- access ------------------------------------------------------------------------------------


def brute_force(events: DataFrame, *, user: str, failed: Column, medium: int = 3, high: int = 5) -> DataFrame:
    """Users by failed accesses: medium from 3, high from 5."""
    n = events.groupBy(user).agg(F.count_if(failed).alias("failures")).where(F.col("failures") >= medium)
    return n.withColumn("severity", F.when(F.col("failures") >= high, "high").otherwise("medium"))


def anomalies(events: DataFrame, *, user: str, resource: str, most: int = 10, resources: int = 5) -> DataFrame:
    """Users with more than ``most`` events, or more than ``resources`` distinct resources."""
    n = events.groupBy(user).agg(F.count("*").alias("events"), F.count_distinct(resource).alias("resources"))
    return n.where((F.col("events") > most) | (F.col("resources") > resources))


def threat_level(failures: Column) -> Column:
    return F.when(failures >= 10, "critical").when(failures >= 5, "high").when(failures >= 3, "medium").otherwise("low")


def access_findings(success: Column, ip: Column, suspicious: list[str]) -> Column:
    return F.array_compact(F.array(F.when(~success, F.lit("failed_access")), F.when(ip.isin(*suspicious), F.lit("suspicious_address"))))


def encryption_findings(algorithm: Column, tls: Column, rotation_days: Column) -> Column:
    """AES-256, TLS 1.2 or later, and key rotation within 90 days are asked for."""
    return F.array_compact(F.array(F.when(F.upper(algorithm) != "AES-256", F.lit("weak_cipher")), F.when(tls < 1.2, F.lit("old_tls")), F.when(rotation_days > 90, F.lit("stale_key"))))


# Parts of names of sensitive fields.
SENSITIVE = (
    "SSN", "SOCIAL", "PASSWORD", "CREDIT", "CARD", "ACCOUNT", "DOB", "BIRTH", "SALARY", "BALANCE", "ROUTING", "TAX-ID",
    "MEDICAL", "PATIENT", "DIAGNOSIS", "PIN", "ENCRYPT", "SECRET",
)


def sensitive(path: Column) -> Column:
    return F.upper(path).rlike("|".join(SENSITIVE))


class Context:
    """Columns that describe an operation; what isn't given counts as false, absent or zero.

    Flags: integrity_protection, segregation_of_duties, role_based_access,
    authorization_required, multi_factor, comprehensive_logging, at_rest_encrypted,
    transit_encrypted, key_management. Texts: classification (such as material or phi),
    at_rest (such as AES-256). Numbers: batch_size, retention_days. notes: map of texts.
    """

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    def on(self, flag: str) -> Column:
        return F.coalesce(self.columns[flag], F.lit(False)) if flag in self.columns else F.lit(False)

    def is_(self, name: str, *values: str) -> Column:
        return F.coalesce(F.lower(self.columns[name]).isin(*values), F.lit(False)) if name in self.columns else F.lit(False)

    def noted(self, *keys: str) -> Column:
        if "notes" not in self.columns:
            return F.lit(False)
        return F.coalesce(F.arrays_overlap(F.map_keys(self.columns["notes"]), F.array(*map(F.lit, keys))), F.lit(False))

    def given(self, name: str) -> Column:
        return self.columns[name].isNotNull() if name in self.columns else F.lit(False)


def _cards(c: Context) -> Column:
    return c.noted("has_cardholder_data", "stores_full_pan", "transmits_cardholder_data")


# Rule, severity, and when it is broken.
RULES = [
    ("SOX-302-001", "high", lambda c: ~(c.on("integrity_protection") & c.is_("classification", "material"))),
    ("SOX-404-001", "high", lambda c: ~c.on("segregation_of_duties")),
    ("HIPAA-ADMIN-001", "high", lambda c: c.is_("classification", "phi") & ~(c.on("role_based_access") & c.on("authorization_required") & c.on("multi_factor") & c.noted("phi_access_justification"))),
    ("HIPAA-TECH-001", "critical", lambda c: c.is_("classification", "phi") & ~(c.is_("at_rest", "aes-256") & c.on("comprehensive_logging"))),
    ("GDPR-ART5-001", "high", lambda c: ~c.noted("gdpr_legal_basis", "processing_purpose")),
    ("GDPR-ART25-001", "medium", lambda c: ~c.given("batch_size")),
    ("PCI-3.1-001", "critical", lambda c: _cards(c) & c.noted("stores_full_pan")),
    ("PCI-3.2-001", "critical", lambda c: _cards(c) & ~c.on("at_rest_encrypted")),
    ("PCI-3.4-001", "high", lambda c: _cards(c) & c.noted("displays_full_pan")),
    ("PCI-3.5-001", "critical", lambda c: _cards(c) & c.on("at_rest_encrypted") & ~c.on("key_management")),
    ("PCI-4.1-001", "critical", lambda c: c.noted("transmits_cardholder_data") & ~c.on("transit_encrypted")),
    ("PCI-7.1-001", "high", lambda c: _cards(c) & ~c.on("role_based_access")),
    ("PCI-8.2-001", "high", lambda c: _cards(c) & ~c.on("multi_factor")),
    ("PCI-10.1-001", "high", lambda c: _cards(c) & ~c.on("comprehensive_logging")),
    ("PCI-10.5.1-001", "high", lambda c: _cards(c) & ~c.on("integrity_protection")),
]
# Standards and the days that their audit records must be kept.
RETENTION = {"SOX": 2555}


def violations(context: dict[str, Column], standards: tuple[str, ...] = ("SOX",)) -> Column:
    """Broken rules of the chosen standards (SOX, HIPAA, GDPR, PCI): array of (rule, severity)."""
    c = Context(context)
    return F.array_compact(F.array(*[F.when(broken(c), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"))) for rule, level, broken in RULES if rule.split("-")[0] in standards]))


def retention_warning(retention_days: Column, standard: str = "SOX") -> Column:
    return retention_days < RETENTION[standard]


def report(events: DataFrame, *, kind: str, failed: Column, slow: Column | None = None) -> DataFrame:
    """One row: events, and the state of compliance, security and performance, each told from
    the events of its kind (compliance, security, performance): not evaluated without any."""
    def state(name: str, bad: Column, worse: str, good: str) -> Column:
        own = F.count_if(F.col(kind) == name)
        return F.when(own == 0, "Not Evaluated").when(F.count_if((F.col(kind) == name) & bad) > 0, worse).otherwise(good).alias(f"{name}_status")

    return events.agg(
        F.count("*").alias("total_events"), state("compliance", failed, "Non-Compliant", "Compliant"),
        state("security", failed, "Issues Detected", "Secure"), state("performance", slow if slow is not None else failed, "Degraded", "Normal"),
    )


def formatted(df: DataFrame, form: str) -> DataFrame:
    """(value): the rows of a report as json, csv, xml or html text."""
    columns = df.columns
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    escaped = [F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) for t in text]
    if form == "json":
        return df.select(F.to_json(F.struct(*columns)).alias("value"))
    if form == "csv":
        quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
        return df.select(F.concat_ws(",", *quoted).alias("value"))
    if form == "xml":
        return df.select(F.concat(F.lit("<row>"), *[F.concat(F.lit(f"<{c}>"), t, F.lit(f"</{c}>")) for c, t in zip(columns, escaped)], F.lit("</row>")).alias("value"))
    if form == "html":
        return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), t, F.lit("</td>")) for t in escaped], F.lit("</tr>")).alias("value"))
    raise ValueError(f"no report as {form}")


# --- lineage -----------------------------------------------------------------------------------


def lineage(source: DataFrame, target: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Leaf fields (position, path, kind) of two layouts by position, and what became of them."""
    s, t = source.select("position", F.col("path").alias("source"), F.col("kind").alias("sk")), target.select("position", F.col("path").alias("target"), F.col("kind").alias("tk"))
    same = F.col("source") == F.col("target")
    kind = F.when(same & (F.col("sk") == F.col("tk")), "direct").when(same, "conversion").otherwise("calculation")
    return s.join(t, "position").select("source", "target", kind.alias("transformation"), F.when(kind == "direct", confidence).otherwise(0.75 * confidence).alias("confidence"))


def impact(uses: DataFrame, *, field: str, system: str) -> DataFrame:
    n = uses.groupBy(field).agg(F.count_distinct(system).alias("systems"))
    risk = F.when(F.col("systems") <= 2, "low").when(F.col("systems") <= 5, "medium").when(F.col("systems") <= 10, "high").otherwise("critical")
    return n.withColumn("risk", risk)


def byte_mix(layout_table: DataFrame) -> DataFrame:
    leaf = layout_table.where(~F.col("kind").isin("group", "condition", "alias"))
    n = F.col("size") * F.col("occurs")
    part = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), n)), F.lit(0))
    return leaf.agg(part("text", "zoned", "edited").alias("display_bytes"), part("packed").alias("packed_bytes"), part("binary", "float", "double").alias("binary_bytes"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bytes"))


# --- logs ----------------------------------------------------------------------------------------


def between(events: DataFrame, ts: str, start, stop) -> DataFrame:
    return events.where(F.col(ts).between(F.lit(start), F.lit(stop)))


def health(events: DataFrame, *, sequence: str, ts: str, partition: list[str], hash_: str = "hash", previous: str = "previous_hash", oldest=None) -> DataFrame:
    """One row: events, broken links, missing hashes, steps back in time, times that can't be
    read (``ts`` may be text), and events before ``oldest``, the end of their retention."""
    w = Window.partitionBy(*partition).orderBy(sequence)
    time = F.col(ts).try_cast("timestamp_ntz") if dict(events.dtypes)[ts] == "string" else F.col(ts)
    e = events.withColumn("_now", time).withColumn("_h", F.lag(hash_).over(w)).withColumn("_t", F.lag("_now").over(w))
    old = F.col("_now") < F.lit(oldest) if oldest is not None else F.lit(False)
    return e.agg(
        F.count("*").alias("events"), F.count_if(F.col("_h").isNotNull() & ~F.col("_h").eqNullSafe(F.col(previous))).alias("broken_links"),
        F.count_if(F.col(hash_).isNull() | (F.col(hash_) == "")).alias("missing_hashes"), F.count_if(F.col("_now") < F.col("_t")).alias("steps_back"),
        F.count_if(F.col(ts).isNotNull() & F.col("_now").isNull()).alias("unreadable_times"), F.count_if(old).alias("past_retention"),
    )


def retained(events: DataFrame, ts: str, oldest) -> DataFrame:
    return events.where(F.col(ts) >= F.lit(oldest))


def rotated(events: DataFrame, *, line: Column, order: list[str], partition: list[str], most: int) -> DataFrame:
    """``events`` with the number (from 0) of the log file that each goes to: a file is closed
    when the bytes before a line, with their line ends, have reached ``most``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(line) + 1).over(w), F.lit(0))
    return events.withColumn("file", (before / most).cast("bigint"))


def parse_events(lines: DataFrame, schema: str, *, column: str = "value") -> DataFrame:
    """Events of a log of JSON lines (or of lines that hold an array of events); ``_bad`` holds
    a line that is neither, with null events."""
    text = F.trim(F.col(column))
    many = F.from_json(text, f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>")
    one = F.from_json(text, schema)
    whole = F.get_json_object(text, "$").isNotNull()
    rows = F.when(~F.coalesce(whole, F.lit(False)), F.array(F.lit(None).cast(one_type(schema)))).when(F.startswith(text, F.lit("[")), many).otherwise(F.array(one))
    bad = F.when(~F.coalesce(whole, F.lit(False)), text)
    return lines.where(text != "").select(bad.alias("_bad"), F.explode(rows).alias("e")).select("_bad", "e.*")


def one_type(schema: str) -> str:
    return f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>"


def json_log(events: DataFrame, columns: list[str]) -> DataFrame:
    """(value): one JSON line for each event."""
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


def cef(vendor: str, product: str, version: str, event: Column, name: Column, level: Column, **extension: Column) -> Column:
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in extension.items()]
    return F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit(version), event, name, level.cast("string"), F.concat_ws(" ", *parts))


def leef(vendor: str, product: str, version: str, event: Column, **extension: Column) -> Column:
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in extension.items()]
    return F.concat(F.concat_ws("|", F.lit("LEEF:2.0"), F.lit(vendor), F.lit(product), F.lit(version), event), F.lit("|"), F.concat_ws("\t", *parts))


def syslog(priority: int, ts: Column, host: str, app: str, message: Column) -> Column:
    return F.concat(F.lit(f"<{priority}>1 "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f" {host} {app} - - - "), message)


# --- performance -----------------------------------------------------------------------------------


def change_status(change: Column) -> Column:
    """Buckets of a relative slowdown: 2, 5 and 15 per cent."""
    return F.when(change < 0.02, "none").when(change < 0.05, "minor").when(change < 0.15, "major").otherwise("critical")


def regressions(current: DataFrame, baseline: DataFrame, *, metric: str, value: str) -> DataFrame:
    """Relative fall of each metric against its baseline, and its bucket."""
    b = baseline.select(metric, F.col(value).alias("baseline"))
    j = current.select(metric, F.col(value).alias("current")).join(b, metric)
    change = F.try_divide(F.col("baseline") - F.col("current"), F.col("baseline"))
    return j.withColumn("change", change).withColumn("status", change_status(F.col("change")))


def drift(changes: DataFrame, *, change: str = "change", threshold: float = 0.05) -> DataFrame:
    """One row over all metrics: mean change and its bucket, and how many fell by more than
    ``threshold`` (the 5 per cent detector)."""
    d = changes.agg(F.avg(change).alias("mean_change"), F.count_if(F.col(change) > threshold).alias("fallen"), F.count("*").alias("metrics"))
    return d.withColumn("status", change_status(F.col("mean_change")))


def promoted(runs: DataFrame, *, metric: str, value: str, day: str, today, keep: int = 90) -> DataFrame:
    """The baseline of each metric: its latest run not older than ``keep`` days."""
    kept = runs.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep))
    return kept.groupBy(metric).agg(F.max_by(value, day).alias(value), F.max(day).alias(day))


def effect_size(df: DataFrame, *, group: str, value: str, first, second) -> DataFrame:
    """Cohen's d of two groups, with their pooled variance."""
    of = lambda k: F.when(F.col(group) == F.lit(k), F.col(value))
    s = df.agg(F.avg(of(first)).alias("m1"), F.avg(of(second)).alias("m2"), F.var_samp(of(first)).alias("v1"), F.var_samp(of(second)).alias("v2"), F.count(of(first)).alias("n1"), F.count(of(second)).alias("n2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return s.select(F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("d"))


def rank_sum(df: DataFrame, *, group: str, value: str, first, second) -> DataFrame:
    """Mann and Whitney's U of the first group; equal values share the mean of their ranks.

    Ranks follow from counts by value: rows are not ordered in one task, only distinct values."""
    of = lambda k: F.count_if(F.col(group) == F.lit(k))
    c = df.where(F.col(group).isin(first, second)).groupBy(value).agg(of(first).alias("a"), of(second).alias("b"))
    before = F.coalesce(F.sum(F.col("a") + F.col("b")).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = c.select("a", "b", (before + (F.col("a") + F.col("b") + 1) / 2).alias("rank"))
    s = rank.agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("n"))
    return s.select((F.col("r") - F.col("n") * (F.col("n") + 1) / 2).alias("u"))


def telemetry(records: DataFrame, *, kind: str, size: str, seconds: str, steps: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """Counters and a histogram by kind: records, bytes, and how many took no longer than each step."""
    upto = [F.count_if(F.col(seconds) <= s).alias(f"le_{str(s).replace('.', '_')}") for s in steps]
    return records.groupBy(kind).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), *upto)


def slo(value: Column, floor: float) -> Column:
    return F.when(value >= floor, "pass").otherwise("fail")


def t_statistic(df: DataFrame, *, group: str, value: str, first, second) -> DataFrame:
    """Welch's statistic of two groups, from their real means and variances."""
    def of(k, suffix):
        c = F.when(F.col(group) == F.lit(k), F.col(value))
        return [F.avg(c).alias(f"m{suffix}"), F.var_samp(c).alias(f"v{suffix}"), F.count(c).alias(f"n{suffix}")]

    s = df.agg(*of(first, 1), *of(second, 2))
    return s.select(((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("t"))
