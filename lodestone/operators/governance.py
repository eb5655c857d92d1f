"""Governance: access, policy, routing, audit chain, consent, erasure, keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import is_complex

# Sensitivity labels, rule types with both their spellings, rule ids and categories, defaults.
SENSITIVE = ("CONFIDENTIAL", "RESTRICTED", "SECRET", "PII")
RULES = (
    ("confidential", ("confidentialchunksneverleavedevice", "confidential_never_leaves_device"), "RULE-RESIDENCY-001", "DATA_RESIDENCY"),
    ("workspace", ("disallowcloudforworkspace", "disallow_cloud_for_workspace"), "RULE-WORKSPACE-001", "WORKSPACE_RESTRICTION"),
    ("roaming", ("blockcloudwhenroaming", "block_cloud_when_roaming"), "RULE-NETWORK-001", "COST_AND_NETWORK_CONTROL"),
    ("regions", ("allowedcloudregions", "allowed_cloud_regions"), "RULE-REGION-001", "GEOGRAPHIC_RESTRICTION"),
    ("providers", ("allowedproviders", "allowed_providers"), "RULE-PROVIDER-001", "PROVIDER_WHITELIST"),
    ("quota", ("maxcloudtokensperday", "max_cloud_tokens_per_day"), "RULE-QUOTA-001", "BUDGET_QUOTA"),
)
DAILY_TOKENS = 100_000
FAILURES, RESET_MS = 3, 60_000
RETAINED = 10_000
HIDDEN_METADATA = ("prompt", "text", "content")
DELETION_PROOF = "PROOF_OF_DELETION"


def acl_matches(metadata: Column, tenant: str | None = None, roles: set[str] | None = None, attributes: dict[str, str] | None = None) -> Column:
    """Tenant, attributes and roles in one predicate for the base scan. Without roles to check every chunk passes that part."""
    same = lambda k, v: F.coalesce(metadata[k] == v, F.lit(False))
    parts = [same("tenant_id", tenant)] if tenant is not None else []
    parts += [same(k, v) for k, v in (attributes or {}).items()]
    if roles:
        own = F.filter(F.transform(F.split(F.coalesce(metadata["acl_roles"], F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != "")
        parts.append(F.arrays_overlap(own, F.array(*[F.lit(r) for r in sorted(roles)])))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def classification_rank(label: Column) -> Column:
    """0 public, 1 internal (also unknown and none), 2 confidential, 3 restricted."""
    up = F.upper(F.coalesce(label, F.lit("INTERNAL")))
    return F.when(up == "PUBLIC", 0).when(up.isin("CONFIDENTIAL", "SECRET"), 2).when(up.isin("RESTRICTED", "TOP_SECRET"), 3).otherwise(1)


def is_authorized(metadata: Column, clearance: Column, roles: Column, department: Column) -> Column:
    """Clearance rank, any required role (ignoring case) and the department (ignoring case)."""
    low = lambda a: F.transform(a, lambda r: F.lower(F.trim(r)))
    needs = F.coalesce(metadata["required_roles"], F.lit(""))
    role_ok = (F.trim(needs) == "") | F.coalesce(F.arrays_overlap(low(F.split(needs, ",")), low(roles)), F.lit(False))
    dept = F.coalesce(metadata["department"], F.lit(""))
    dept_ok = (F.trim(dept) == "") | F.coalesce(F.lower(dept) == F.lower(department), F.lit(False))
    return (clearance >= classification_rank(metadata["sensitivity"])) & role_ok & dept_ok


def parse_policy(documents: DataFrame, text: str = "json") -> DataFrame:
    """(rule_order, kind, rule_id, category, items, max_tokens) from policy JSON, an array or {"rules": [...]}. Unknown types are skipped."""
    rule = "struct<type:string,workspaceIds:array<string>,workspaces:array<string>,allowedRegions:array<string>,regions:array<string>,allowedProviderIds:array<string>,providers:array<string>,maxTokens:bigint>"
    trimmed = F.trim(F.col(text))
    rules = F.coalesce(F.when(trimmed.startswith("["), F.from_json(trimmed, f"array<{rule}>")), F.from_json(trimmed, f"struct<rules:array<{rule}>>")["rules"])
    each = documents.select(F.posexplode(rules).alias("rule_order", "r"))
    kind = rule_id = category = F.lit(None).cast("string")
    for name, spellings, ident, cat in RULES:
        is_it = F.lower("r.type").isin(*spellings)
        kind, rule_id, category = F.when(is_it, name).otherwise(kind), F.when(is_it, ident).otherwise(rule_id), F.when(is_it, cat).otherwise(category)
    first = lambda a, b: F.when(F.size(F.coalesce(F.col(a), F.array())) > 0, F.col(a)).otherwise(F.coalesce(F.col(b), F.array()))
    none = F.array().cast("array<string>")
    items = (
        F.when(kind == "workspace", first("r.workspaceIds", "r.workspaces")).when(kind == "regions", first("r.allowedRegions", "r.regions"))
        .when(kind == "providers", first("r.allowedProviderIds", "r.providers")).when(kind == "confidential", F.array(*[F.lit(x) for x in SENSITIVE])).otherwise(none)
    )
    out = each.select("rule_order", kind.alias("kind"), rule_id.alias("rule_id"), category.alias("category"), items.alias("items"), F.when(kind == "quota", F.coalesce("r.maxTokens", F.lit(DAILY_TOKENS).cast("long"))).alias("max_tokens"))
    return out.where("kind is not null")


def denies(kind: Column, items: Column, max_tokens: Column, used: Column | None = None) -> Column:
    """Whether a rule denies a request with the columns locality, labels, workspace, roaming, provider, region, tokens."""
    cloud = F.coalesce(F.upper("locality") == "CLOUD", F.lit(False))
    labels = F.transform(F.split(F.coalesce("labels", F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    spent = used if used is not None else F.lit(0)
    test = (
        F.when(kind == "confidential", cloud & F.arrays_overlap(labels, items))
        .when(kind == "workspace", cloud & F.col("workspace").isNotNull() & F.array_contains(items, F.col("workspace")))
        .when(kind == "roaming", cloud & F.coalesce("roaming", F.lit(False)))
        .when(kind == "regions", cloud & F.col("region").isNotNull() & ~F.array_contains(items, F.col("region")))
        .when(kind == "providers", F.col("provider").isNotNull() & ~F.array_contains(items, F.col("provider")))
        .when(kind == "quota", cloud & (spent + F.coalesce("tokens", F.lit(0)) > max_tokens))
    )
    return F.coalesce(test, F.lit(False))


#: Rules up to this number become one expression; more are joined as one array.
EXPRESSION_RULES = 200


def evaluate_policy(requests: DataFrame, rules: DataFrame, ident: str = "request_id", used: str | None = None) -> DataFrame:
    """(request_id, decision, rule_id, category): the first denying rule in order, else allowed. Each rule is looked at
    once for a request; tokens are charged when a request runs, not here."""
    spent = F.col(used) if used else None
    cols = ["rule_order", "kind", "items", "max_tokens", "rule_id", "category"]
    few = rules.select(*cols).orderBy("rule_order").limit(EXPRESSION_RULES + 1).collect()
    if len(few) <= EXPRESSION_RULES:
        found = lambda r: F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["category"]).alias("category"))
        items = lambda r: F.array(*map(F.lit, r["items"] or [])).cast("array<string>")
        tests = [F.when(denies(F.lit(r["kind"]), items(r), F.lit(r["max_tokens"]).cast("long"), spent), found(r)) for r in few]
        judged = requests.withColumn("__deny", F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule_id:string,category:string>"))
    else:
        listed = rules.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("__rules"))
        first = F.get(F.filter("__rules", lambda r: denies(r["kind"], r["items"], r["max_tokens"], spent)), 0)
        judged = requests.crossJoin(listed).withColumn("__deny", first)
    return judged.select(ident, F.when(F.col("__deny").isNotNull(), "denied").otherwise("allowed").alias("decision"), F.col("__deny.rule_id").alias("rule_id"), F.col("__deny.category").alias("category"))


def integrity_gate(rooted: Column, recognized: Column) -> Column:
    """The rule that stops a compromised device before any policy, null if none does."""
    return F.when(rooted, "DEVICE_INTEGRITY_ROOT_DETECTED").when(~recognized, "DEVICE_INTEGRITY_PLAY_ATTESTATION_FAILED")


def breaker_state(events: DataFrame, now_ms: Column | int) -> DataFrame:
    """(provider, failures, last_failure_ms, state) from (provider, ts_ms, ok): failures since the last success; open at
    three, half open a minute after the last."""
    success = F.max(F.when(F.col("ok"), F.col("ts_ms"))).over(W.partitionBy("provider"))
    since = events.withColumn("__s", success)
    counted = since.groupBy("provider").agg(F.count(F.when(~F.col("ok") & (F.col("__s").isNull() | (F.col("ts_ms") > F.col("__s"))), 1)).alias("failures"), F.max(F.when(~F.col("ok"), F.col("ts_ms"))).alias("last_failure_ms"))
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    state = F.when(F.col("failures") < FAILURES, "CLOSED").when(now - F.col("last_failure_ms") >= RESET_MS, "HALF_OPEN").otherwise("OPEN")
    return counted.withColumn("state", state)


def route(requests: DataFrame) -> DataFrame:
    """Adds provider (local, cloud or none) and reason.

    Columns: mode, query, labels array<string>, context_tokens, history_turns, max_tokens,
    tier, battery, charging, thermal, network, roaming, breaker_open, policy_rule (of a
    cloud denial, null if allowed), local_available, has_local, has_cloud, local_window.
    The checks apply in a fixed order and the first that speaks decides.
    """
    c = F.col
    local_ok = c("has_local") & c("local_available")
    secret = F.exists(c("labels"), lambda x: F.upper(x).isin(*SENSITIVE))
    denied = c("policy_rule").isNotNull() | ~c("has_cloud")
    rule = F.coalesce(c("policy_rule"), F.lit("NO_CLOUD_CONFIGURED"))
    to = lambda where, reason: F.struct(where.alias("provider") if isinstance(where, Column) else F.lit(where).alias("provider"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    here = F.when(local_ok, "local").otherwise("none")
    complex_query = is_complex(c("query"), c("history_turns"), c("max_tokens"))
    decision = (
        F.when(c("mode") == "LOCAL_ONLY", to(here, F.when(local_ok, "LOCAL_ONLY_CONFIG").otherwise("MODEL_UNAVAILABLE")))
        .when(c("mode") == "CLOUD_ONLY", F.when(denied, to("none", "POLICY_VIOLATION")).otherwise(to("cloud", "CLOUD_ONLY_CONFIG")))
        .when(c("network") == "NONE", to(here, F.when(local_ok, "OFFLINE_NETWORK").otherwise("MODEL_UNAVAILABLE")))
        .when(secret, to(here, F.when(local_ok, "CONFIDENTIAL_RESTRICTION").otherwise("MODEL_UNAVAILABLE")))
        .when(denied, to(here, F.when(~local_ok, "MODEL_UNAVAILABLE").when(rule.contains("NETWORK") | c("roaming"), "ROAMING_RESTRICTION").when(rule.contains("QUOTA"), "DAILY_TOKEN_QUOTA_EXCEEDED").otherwise("WORKSPACE_RESTRICTION")))
        .when(c("thermal").isin("SEVERE", "CRITICAL"), to("cloud", "THERMAL_THROTTLED"))
        .when((c("battery") < 15) & ~c("charging"), to("cloud", "BATTERY_LOW"))
        .when(c("has_local") & (c("context_tokens") > c("local_window")), to("cloud", "CONTEXT_WINDOW_EXCEEDED"))
        .when(c("has_local") & c("breaker_open"), to("cloud", "CIRCUIT_BREAKER_TRIPPED"))
        .when((c("tier") != "HIGH_END") & complex_query, to("cloud", "QUERY_COMPLEXITY_HIGH"))
        .when((c("mode") == "LOCAL_FIRST") & local_ok, to("local", "DEFAULT_PREFERENCE"))
        .when(c("mode") == "LOCAL_FIRST", to("cloud", "FALLBACK_ALLOWED"))
        .otherwise(to("cloud", "DEFAULT_PREFERENCE"))
    )
    return requests.withColumn("__d", decision).select(*requests.columns, c("__d.provider").alias("provider"), c("__d.reason").alias("reason"))


def sanitized_metadata(metadata: Column) -> Column:
    """key=value pairs in key order, joined by semicolons, without keys that hold content."""
    entries = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin(*HIDDEN_METADATA))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


def entry_payload(seq: Column, previous: Column, ts: Column, action: Column, actor: Column, model: Column, docs: Column, metadata_hash: Column) -> Column:
    return F.concat_ws("|", seq.cast("string"), previous, ts.cast("string"), action, actor, model, F.array_join(docs, ","), metadata_hash)


def append_chain(events: DataFrame, seed: str, chain: str = "chain") -> DataFrame:
    """Hash-chained entries of (chain, seq, ts_ms, action, actor, model, document_ids, metadata_hash).

    Each entry's hash covers the one before, so a chain is worked off in order
    by one task: the chain is the unit of parallel work. Give each tenant its own,
    and a tenant that writes without end one for each day or source. Rows of a chain stream through
    in Arrow batches, only the last hash is held.
    """
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    schema = f"{chain} string, seq long, ts_ms long, action string, actor string, model string, document_ids string, metadata_hash string, previous_hash string, current_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, ""
        for b in batches:
            prev, cur = [], []
            for name, seq, *rest in zip(*(b[c].tolist() for c in b.columns), strict=True):
                if name != now:
                    now, last = name, sha(seed)
                prev.append(last)
                last = sha("|".join(map(str, (seq, last, *rest))))
                cur.append(last)
            yield b.assign(previous_hash=prev, current_hash=cur)

    cols = [chain, "seq", "ts_ms", "action", "actor", "model", "document_ids", "metadata_hash"]
    return events.select(F.col(chain).cast("string").alias(chain), *cols[1:]).repartition(chain).sortWithinPartitions(chain, "seq").mapInPandas(run, schema)


def verify_chain(ledger: DataFrame, seed: str, chain: str = "chain") -> DataFrame:
    """(chain, entries, broken_seq, reason): the first entry whose link or hash is wrong, null if none. An entry with
    sequence 0 must follow the seed; the first entry of a pruned chain is taken on trust."""
    by = W.partitionBy(chain).orderBy("seq")
    before = F.coalesce(F.lag("current_hash").over(by), F.when(F.col("seq") == 0, F.sha2(F.lit(seed), 256)), F.col("previous_hash"))
    payload = F.concat_ws("|", F.col("seq").cast("string"), "previous_hash", F.col("ts_ms").cast("string"), "action", "actor", "model", "document_ids", "metadata_hash")
    reason = F.when(F.col("previous_hash") != before, "link").when(F.col("current_hash") != F.sha2(payload, 256), "hash")
    judged = ledger.withColumn("reason", reason)
    return judged.groupBy(chain).agg(F.count("*").alias("entries"), F.min(F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("broken_seq"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"))


def retain(ledger: DataFrame, n: int = RETAINED, chain: str = "chain") -> DataFrame:
    """The newest n entries of each chain."""
    return ledger.withColumn("__n", F.row_number().over(W.partitionBy(chain).orderBy(F.col("seq").desc()))).where(F.col("__n") <= n).drop("__n")


def latest_consent(events: DataFrame) -> DataFrame:
    """(user_id, purpose, granted, ts): the last word of each user on each purpose."""
    last = events.groupBy("user_id", "purpose").agg(F.max(F.struct("ts", "event_id", "granted")).alias("l"))
    return last.select("user_id", "purpose", F.col("l.granted").alias("granted"), F.col("l.ts").alias("ts"))


def withdrawals(events: DataFrame) -> DataFrame:
    """Events at which a granted consent is withdrawn."""
    before = F.lag("granted").over(W.partitionBy("user_id", "purpose").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(F.col("before") & ~F.col("granted")).drop("before")


def daily_usage(events: DataFrame, limit: int = DAILY_TOKENS, ts: str = "ts", tokens: str = "tokens") -> DataFrame:
    """(day, tokens, over_limit) by UTC day; negative amounts count nothing."""
    return events.groupBy(F.to_date(F.date_trunc("day", ts)).alias("day")).agg(F.sum(F.greatest(F.col(tokens), F.lit(0))).alias("tokens")).withColumn("over_limit", F.col("tokens") > limit)


def deletion_proof(request: Column, user: Column, items: Column, ts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(DELETION_PROOF), request, user, items.cast("string"), ts.cast("string")), 256)


def deletion_receipts(requests: DataFrame, holdings: DataFrame) -> DataFrame:
    """(request_id, user_id, documents, chunks, proof) for erasure requests (request_id, user_id, ts_ms); holdings: (user_id, document_id, chunks)."""
    own = holdings.groupBy("user_id").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    j = requests.join(own, "user_id", "left").select("request_id", "user_id", "ts_ms", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return j.withColumn("proof", deletion_proof(F.col("request_id"), F.col("user_id"), F.col("documents") + F.col("chunks"), F.col("ts_ms"))).drop("ts_ms")


def encrypt(content: Column, key: Column) -> Column:
    """AES-GCM: IV (12 bytes), ciphertext, tag (16 bytes)."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypt(content: Column, key: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("GCM"))


def rotate_keys(keys: DataFrame, old: Column, new: Column) -> DataFrame:
    """Wrapped data keys re-wrapped under a new key; the data stays as it is. Dropping a row shreds what it protects."""
    return keys.withColumn("wrapped", encrypt(decrypt(F.col("wrapped"), old), new))


def rule_table(spark: SparkSession, *rules: tuple[str, list[str] | int | None]) -> DataFrame:
    """A rules table from (kind, items or token limit) pairs, in order: the shape that parse_policy() gives. A reload is a new table."""
    names = {kind: (ident, cat) for kind, _, ident, cat in RULES}
    rows = []
    for n, (kind, arg) in enumerate(rules):
        items = list(SENSITIVE) if kind == "confidential" and arg is None else arg if isinstance(arg, list) else []
        rows.append((n, kind, *names[kind], items, (arg if isinstance(arg, int) else DAILY_TOKENS) if kind == "quota" else None))
    return spark.createDataFrame(rows, "rule_order int, kind string, rule_id string, category string, items array<string>, max_tokens long")


def missing_keys(collections: DataFrame, keys: DataFrame, wrapping: Column) -> DataFrame:
    """(collection_id, wrapped) for collections without a data key: a random key of 16 bytes, wrapped. Write it before
    use, as each evaluation draws anew."""
    fresh = collections.select("collection_id").distinct().join(keys.select("collection_id"), "collection_id", "left_anti")
    return fresh.withColumn("wrapped", encrypt(F.expr("unhex(replace(uuid(), '-', ''))"), wrapping))


def append_rows(rows: DataFrame, path: str) -> None:
    """An append-only sink for audit and telemetry rows."""
    rows.write.mode("append").parquet(path)
