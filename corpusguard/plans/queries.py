"""Every operator applied to the driver's tables, by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions import text as tx
from corpusguard.functions.fingerprints import fingerprints
from corpusguard.functions.checksum import checksum
from corpusguard.functions.percentile import lower_index, lower_indexes
from corpusguard.mail import metrics, rules as mail_rules, split
from corpusguard.mail.parse import visible_html
from corpusguard.operators import findings, ledger, paths
from corpusguard.operators.detect import detect, may_hold_tokens, redact_texts, rescan
from corpusguard.operators.rules import PORTABLE, ruleset_version
from corpusguard.functions.udfs import register
from corpusguard.plans.planted import with_tokens
from corpusguard.sources.files import named_events, replayed

#: Of the registered queries only; an operator uses a key of their own.
QUERY_KEY = b"key of the registered queries"
AS_OF = "2024-06-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


# Detection and redaction


@_query
def entropy_by_lang(t):
    """Generic tokens, and those of high entropy, by language and source."""
    docs = t("documents").where(F.col("text").rlike("[A-Za-z0-9+]{32}"))
    tokens = docs.select("lang", "source", F.explode(tx.generic_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.is_high_entropy(F.col("token"))).alias("n_high"), F.sum(tx.entropy(F.col("token"))).alias("bits"))


@_query
def rule_hits_by_source(t):
    """Matches of the rules that any regular-expression engine agrees on, with zeros."""
    docs = with_tokens(t("documents")).where(may_hold_tokens(F.col("text")))
    counts = [F.struct(F.lit(name).alias("rule_id"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n")) for name, p in PORTABLE.items()]
    hits = docs.select("source", F.explode(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("hit"))
    found = hits.groupBy("source", F.col("hit.rule_id").alias("rule_id")).agg(F.sum("hit.n").alias("n"))
    every = t("documents").select("source").distinct().select("source", F.explode(F.array(*[F.lit(name) for name in PORTABLE])).alias("rule_id"))
    return every.join(found, ["source", "rule_id"], "left").select("source", "rule_id", F.coalesce("n", F.lit(0)).alias("n"))


@_query
def detect_findings(t):
    found = detect(with_tokens(t("documents")), QUERY_KEY, AS_OF)
    return found.select("doc_id", "source", "rule_id", "span_start", "span_end", "line_no", "context_name", "fingerprint", "value_len", "origin", "triage")


@_query
def findings_by_rule(t):
    found = detect(with_tokens(t("documents")), QUERY_KEY, AS_OF)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("n_values"))


@_query
def redact_documents(t):
    return redact_texts(with_tokens(t("documents"))).select("doc_id", "lang", "source", "text", "n_redacted")


@_query
def redact_by_function(t):
    """The registered functions, called by name in SQL."""
    spark = t("documents").sparkSession
    register(spark)
    rows = with_tokens(t("documents")).where(may_hold_tokens(F.col("text"))).selectExpr("doc_id", "detect_spans(text) AS spans", "redact(text) AS text")
    return rows.select("doc_id", F.size("spans").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256")).where("n > 0")


@_query
def excluded_paths(t):
    path = F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    odd = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("/vendor"), path)).when(F.col("page_id") % 7 == 1, F.concat(path, F.lit("/App.Test.tsx"))).otherwise(path)
    return t("pages").select("page_id", paths.is_excluded(odd).alias("excluded"))


@_query
def diff_parts(t):
    """Diffs made of two documents' file names, cut into files."""
    name = F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"))
    diff = F.when(F.col("doc_id") % 3 == 0, F.lit("no header")).otherwise(F.concat(F.lit("lead\n"), head, F.lit("+one\n"), head, F.lit("+two\n")))
    return paths.split_diff(t("documents").select("doc_id", diff.alias("text"))).select("doc_id", "part_no", "path", "part")


# Findings: merging, searching, counting


def _as_findings(t):
    """Orders in the shape of findings."""
    place = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(paths.DIFF_PREFIX), F.lit("p"), F.col("o_orderkey"))
    return t("orders").select(
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderpriority").alias("rule_id"),
        F.col("o_orderstatus").alias("fingerprint"),
        place.alias("path"),
        F.when(F.col("o_orderkey") % 3 == 0, "path").otherwise("diff").alias("origin"),
        (F.col("o_orderkey") % 100).cast("int").alias("line_no"),
        F.lit(None).cast("string").alias("context_name"),
        (F.col("o_orderkey") % 50).cast("string").alias("seq_id"),
        F.col("o_orderkey").alias("arrival"),
        F.lit("unknown").alias("triage"),
    )


@_query
def merge_findings(t):
    rows = _as_findings(t)
    merged = findings.merge(rows.where("arrival % 2 = 1"), rows.where("arrival % 2 = 0"))
    return merged.select(*findings.KEY, "path", "origin", "line_no", F.array_join("seen_in", ",").alias("seen_in"))


def _orders_of_customers(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))


@_query
def status_counts_zero_filled(t):
    return findings.counted(t("orders"), "o_orderstatus", ["F", "O", "P", "X"])


@_query
def count_by_type(t):
    return findings.matching(t("orders"), o_orderstatus=["F"], o_custkey=None).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query
def entity_options(t):
    return findings.options(_orders_of_customers(t), "c_custkey", ["c_name"], "o_orderstatus", ("F", "O", "unknown"), "unknown")


@_query
def top_entities(t):
    out = findings.options(_orders_of_customers(t), "c_custkey", ["c_name"], "o_orderstatus", ("F", "O", "unknown"), "unknown")
    return findings.page(out.select("c_custkey", "c_name", "count"), [F.desc("count"), F.asc("c_custkey")], limit=20)


@_query
def cross_filter_facets(t):
    rows = _orders_of_customers(t).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return findings.facets(rows, {"n_name": [], "o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@_query
def page_with_total(t):
    orders = findings.matching(t("orders"), o_orderstatus=["O"])
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    shown = findings.page(orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], limit=100, offset=50)
    return shown.join(F.broadcast(total))


@_query
def free_text_search(t):
    rows = t("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("owner"), F.lit(None).cast("string").alias("path"), F.lit("x_%").alias("context_name"))
    one = findings.searched(rows, "uild/00001").select("c_custkey", F.lit("slash").alias("kind"))
    two = findings.searched(rows, "MACHINE").select("c_custkey", F.lit("plain").alias("kind"))
    return one.unionByName(two).unionByName(findings.searched(rows, "y%").select("c_custkey", F.lit("none").alias("kind")))


def _grants(t):
    owner = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    status = F.when(F.col("c_custkey") % 5 == 0, "approved").otherwise("pending")
    return t("customer").select(owner.alias("owner"), F.lower("c_name").alias("name"), status.alias("status"))


@_query
def scope_semi_join(t):
    rows = _orders_of_customers(t).select("o_orderkey", F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"))
    return findings.in_scope(rows, _grants(t)).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@_query
def scope_without_grants(t):
    rows = _orders_of_customers(t).select("o_orderkey", F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"))
    return findings.in_scope(rows, _grants(t).where("status = 'refused'")).agg(F.count(F.lit(1)).alias("n"))


@_query
def pending_anti_join(t):
    """Documents without a label; a label that is toxic counts as failed."""
    return findings.pending(t("documents"), t("labels").where("quality is not null"), "doc_id", F.col("toxic") == 1).select("doc_id", "source")


@_query
def orphan_results(t):
    """Results whose id or source the corpus does not have."""
    saved = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select((F.col("doc_id") + (F.col("doc_id") % 10 == 0).cast("int") * 1_000_000_000).alias("doc_id"), "source")
    return findings.orphans(saved, t("documents"), ["doc_id", "source"])


@_query
def counts_or_zero(t):
    """Each customer with the count of all orders and of two states, 0 without any."""
    states = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("head"), F.count_if(F.col("o_orderstatus") == "O").alias("history"))
    return findings.with_counts(t("customer").select("c_custkey"), states, "c_custkey")


@_query
def two_key_sort(t):
    """Nulls come last in descending order."""
    done = F.when(F.col("event_id") % 3 == 0, F.col("ts"))
    rows = t("events").select("event_id", done.alias("finished_at"), F.col("ts").alias("started_at"))
    return findings.page(rows, [F.desc_nulls_last("finished_at"), F.desc_nulls_last("started_at"), F.desc("event_id")], limit=200)


@_query
def claim_oldest(t):
    rows = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return findings.page(rows, [F.asc("o_orderdate"), F.asc("o_orderkey")], limit=25)


@_query
def deterministic_sample(t):
    return findings.sample(t("orders").select("o_orderkey"), "o_orderkey", 500, 17)


@_query
def first_source_wins(t):
    """Texts of several sources belong to the first one."""
    return findings.first_source_wins(t("documents").select("source", "doc_id", "text"), F.sha2("text", 256), ["source", "doc_id"]).drop("text")


@_query
def union_of_sources(t):
    parts = [t(name).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("id")) for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@_query
def last_write_wins(t):
    return replayed(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@_query
def json_field_filter(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", k.alias("k")).where("k >= 50")


@_query
def named_event_lines(t):
    """JSON lines made of events; some are broken, of another type or without a slash."""
    name = F.when(F.col("event_id") % 4 == 0, F.lit("plain")).otherwise(F.concat(F.lit("own"), F.col("user_id"), F.lit("/n/"), F.col("event_type")))
    line = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "Other").otherwise("PushEvent").alias("type"), F.struct(name.alias("name"), F.col("event_id").alias("id")).alias("repo")))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    return named_events(t("events").select(line.alias("value")))


@_query
def json_strings(t):
    made = F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('", 1, null, "x"'), F.when(F.col("c_custkey") % 9 == 0, "").otherwise("]"))
    return t("customer").select("c_custkey", F.array_join(tx.json_strings(made), "|").alias("strings"))


# Text functions


@_query
def collapsed_text(t):
    return t("documents").select("doc_id", tx.collapsed(F.col("text"), 200).alias("text"))


@_query
def unicode_words(t):
    return t("documents").select("doc_id", F.size(tx.unicode_words(F.col("text"))).cast("long").alias("n"))


@_query
def url_hosts(t):
    host = tx.url_host(F.col("url"))
    rows = t("pages").select("page_id", host.alias("host"), tx.is_host_or_subdomain(host, F.lit("example.com")).alias("inside"))
    return rows


@_query
def urls_in_pages(t):
    links = F.size(tx.urls_in(F.concat(F.lit("see "), F.col("url"), F.lit(" and <"), F.col("url"), F.lit(">"))))
    return t("pages").select("page_id", links.cast("long").alias("n"))


@_query
def exact_dup_groups(t):
    groups = t("documents").where("text is not null").groupBy(F.sha2("text", 256).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.count_distinct("lang").alias("langs"))
    return groups.where("n > 1")


@_query
def corpus_checksum(t):
    return checksum(t("documents"), ["doc_id", "text"])


@_query
def message_fingerprints(t):
    made = fingerprints(F.lit(""), F.col("text"))
    return t("documents").select("doc_id", made.alias("f")).select("doc_id", "f.id", "f.simhash")


@_query
def visible_pages(t):
    return t("pages").select("page_id", visible_html(F.col("html")).alias("v")).select("page_id", "v.text", F.size("v.links").alias("n_links"))


# Mail


def _sources():
    known = ["nazario-2022", "nazario-2024", "phishing-pot", "trec05", "trec07", "spamassassin-easy_ham", "spamassassin-easy_ham_2", "spamassassin-hard_ham", "other"]
    return F.element_at(F.array(*[F.lit(s) for s in known]), (F.col("doc_id") % len(known)).cast("int") + 1)


@_query
def source_split_case(t):
    rows = t("documents").select("doc_id", _sources().alias("mail_source"))
    source = F.col("mail_source")
    return rows.select("doc_id", split.split_of(source).alias("a"), split.split_of(source, True).alias("b"), split.split_of(source, False, True).alias("c"), split.year_of(source).alias("year"))


def _outcomes(t):
    label = F.when(F.col("quality") == 0, "phishing").otherwise("ham")
    choice = F.when(F.col("toxic") == 1, "suspicious").when(F.col("doc_id") % 11 == 0, "review").when(F.col("doc_id") % 13 == 0, "odd").otherwise("no_signals")
    return t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", label.alias("label"), choice.alias("status"))


@_query
def confusion_matrix(t):
    return metrics.confusion(_outcomes(t), ["lang"])


@_query
def confusion_metrics(t):
    return metrics.rounded(metrics.summary(_outcomes(t), []))


@_query
def grouped_metrics(t):
    """By all, by language and by source: rows repeat per grouping before one pass."""
    rows = _outcomes(t)
    groups = F.array(*[F.struct(F.lit(name).alias("grouping"), value.alias("value")) for name, value in (("all", F.lit("")), ("lang", F.col("lang")), ("source", F.col("source")))])
    return metrics.rounded(metrics.summary(rows.select("label", "status", F.inline(groups)), ["grouping", "value"]))


@_query
def class_weights(t):
    return metrics.class_weights(t("labels"), "quality")


@_query
def latency_p95_lower_index(t):
    timed = t("events").where("value >= 0 and value < 120000")
    return lower_indexes(timed, ["event_type"], "value", {"p95": 0.95, "p99": 0.99}, medians=("median",))


@_query
def latency_p95_overall(t):
    return lower_index(t("events").where("value >= 0 and value < 120000"), [], "value", 0.95, "p95")


@_query
def cost_totals(t):
    return metrics.totals(t("events"), F.when(F.col("event_id") % 6 != 0, F.col("value")), F.col("event_id") % 10 == 0)


def _messages(t):
    made = fingerprints(F.lit(""), F.col("text"))
    label = F.when(F.coalesce("quality", F.lit(1)) == 0, "phishing").otherwise("ham")
    rows = t("documents").join(t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left").where("text is not null")
    return rows.select(made.alias("f"), _sources().alias("source"), F.format_string("%012d", "doc_id").alias("source_id"), label.alias("label")).select("f.id", "f.simhash", "source", "source_id", "label")


@_query
def split_corpus(t):
    return split.prepare(_messages(t))[0].select("id", "source", "source_id", "label", "split")


def _hashed(t):
    """Messages with given simhashes: groups whose members differ from a common value
    in two bits each, so some are linked only through others."""
    group, member = (F.col("doc_id") % 150).cast("string"), F.floor(F.col("doc_id") / 150)
    common = F.conv(F.substring(F.md5(group), 1, 15), 16, 10).cast("long")
    flips = [F.call_function("shiftleft", F.lit(1).cast("long"), (member * n % 60).cast("int")) for n in (7, 13)]
    simhash = common.bitwiseXOR(flips[0]).bitwiseXOR(flips[1])
    label = F.when(F.col("doc_id") % 10 == 3, "phishing").otherwise("ham")
    rows = t("documents").select(simhash.alias("simhash"), _sources().alias("source"), F.format_string("%012d", "doc_id").alias("source_id"), label.alias("label"))
    return rows.select(F.md5(F.col("simhash").cast("string")).alias("id"), "*")


@_query
def near_duplicate_clusters(t):
    return split.clusters(_hashed(t)).select("source_id", "simhash", "cluster")


@_query
def split_of_hashes(t):
    return split.prepare(_hashed(t))[0].select("id", "source", "source_id", "label", "split")


@_query
def split_exclusions(t):
    return split.exclusions(split.clusters(_hashed(t)))


@_query
def split_manifest(t):
    messages = _hashed(t)
    kept, policy, clustered = split.prepare_clustered(messages)
    made = split.manifest(messages, kept, split.exclusions(clustered), policy, 17)
    return made.select("seed", "split_policy", *[F.to_json(c).alias(c) for c in ("source_counts", "split_counts", "excluded")])


@_query
def mail_assessment(t):
    """Messages made of pages: the sender's domain, and a link that may be labelled otherwise."""
    host = tx.url_host(F.col("url"))
    shown = F.when(F.col("page_id") % 4 == 0, F.lit("https://other.example/")).when(F.col("page_id") % 4 == 1, F.col("url")).otherwise("here")
    link = F.struct(shown.alias("text"), F.col("url").alias("url"))
    sender = F.struct(F.lit("n").alias("name"), F.concat(F.lit("a@"), F.when(F.col("page_id") % 2 == 0, host).otherwise(F.lit("Example.ORG"))).alias("email"))
    text = F.when(F.col("page_id") % 5 == 0, F.lit("Please ENTER your Password")).otherwise("hello")
    message = F.struct(sender.alias("sender"), F.lit("s").alias("subject"), text.alias("text"), F.array(link).alias("links"), F.array().cast("array<string>").alias("attachments"), (F.col("page_id") % 6 == 0).alias("truncated"))
    choice = F.when(F.col("page_id") % 7 == 0, "review").when(F.col("page_id") % 7 == 1, "nonsense").otherwise("no_signals")
    out = mail_rules.assess(t("pages").select("page_id", message.alias("message"), choice.alias("choice")))
    return out.select("page_id", F.array_join("observations", ",").alias("observations"), "status", F.size("limitations").cast("long").alias("n_limitations"))


# The ledger


def _work(t):
    status = F.element_at(F.array(*[F.lit(s) for s in ledger.WORK_STATES]), (F.col("o_orderkey") % 5).cast("int") + 1)
    reason = F.when(F.col("o_orderkey") % 4 == 0, ledger.GONE).when(F.col("o_orderkey") % 4 == 1, "time")
    return t("orders").select(
        F.col("o_orderkey").cast("long").alias("source_id"),
        status.alias("status"),
        F.when(status == "done", (F.col("o_orderkey") % 1000).cast("string")).alias("watermark"),
        F.when(status == "done", F.when(F.col("o_orderkey") % 10 == 2, ruleset_version()).otherwise("old")).alias("ruleset_version"),
        (F.col("o_orderkey") % 3).cast("int").alias("epoch"),
        (F.col("o_orderkey") % 7).cast("int").alias("retry"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        reason.alias("reason"),
    )


def _by_status(work):
    return work.groupBy("status", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids"))


@_query
def ledger_requeue_stale(t):
    return _by_status(ledger.requeue_stale(_work(t), 3600, "1996-01-01 00:00:00"))


@_query
def ledger_requeue_failed(t):
    return _by_status(ledger.requeue_failed(_work(t), 3))


@_query
def ledger_cancel_before(t):
    work = _work(t)
    phases = ledger.seeded(work)
    return _by_status(ledger.cancel_before(phases, work, 2, AS_OF)[1])


@_query
def ledger_claim(t):
    return _by_status(ledger.claim(_work(t), 100, 1, AS_OF))


@_query
def ledger_seed_phases(t):
    return ledger.seeded(_work(t)).groupBy("phase", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids"))


@_query
def ledger_claimable(t):
    work = _work(t)
    phases = ledger.seeded(work.withColumn("status", F.lit("done")).withColumn("watermark", F.lit("1")).withColumn("ruleset_version", F.lit("v")))
    pending = phases.withColumn("status", F.when(F.col("source_id") % 2 == 0, "pending").otherwise("done"))
    return ledger.claimable(pending, work, "head", 1).select("source_id", "target")


def _phases(t):
    """Phases of every order in all states, with targets 1 to 4."""
    status = F.element_at(F.array(*[F.lit(x) for x in ledger.PHASE_STATES]), (F.col("o_orderkey") % 6).cast("int") + 1)
    return t("orders").select(
        F.col("o_orderkey").cast("long").alias("source_id"),
        F.explode(F.array(*[F.lit(p) for p in ledger.PHASE_NAMES])).alias("phase"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, ledger.ANY_TARGET).otherwise((F.col("o_orderkey") % 4 + 1).cast("string")).alias("target"),
        F.when(status == "done", "0").alias("completed"),
        F.lit(None).cast("string").alias("ruleset_version"),
        (F.col("o_orderkey") % 3).cast("int").alias("epoch"),
        F.lit(0).alias("retry"),
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("string").alias("reason"),
    )


def _few(t, f):
    """The states after a transition of each of some sources."""
    work, phases = _work(t), _phases(t)
    picked = work.where("source_id <= 64").drop("_")
    few = phases.join(picked.select("source_id"), "source_id", "left_semi")
    # A transition changes one source's rows only, so each is given those alone: the
    # state after sixteen in turn would be a plan that doubles with each.
    moved = [1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 36, 37, 38, 39, 64]
    others = ~F.col("source_id").isin(moved)
    parts = [(few.where(others), picked.where(others))]
    parts += [f(few.where(F.col("source_id") == i), picked.where(F.col("source_id") == i), i) for i in moved]
    return tuple(functools.reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))


@_query
def queue_status(t):
    return ledger.queue_status(_work(t))


@_query
def phase_lookup(t):
    """Both phases of each source beside it; sources without any have nulls."""
    return ledger.with_phases(_work(t).select("source_id"), _phases(t).where("source_id % 7 <> 0 and not (phase = 'history' and source_id % 4 = 1)"))


@_query
def ledger_add(t):
    arriving = t("lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 1, 0).otherwise(1_000_000)).alias("source_id"))
    return _by_status(ledger.add(_work(t), arriving))


@_query
def ledger_schedule(t):
    after, _ = _few(t, lambda phases, work, i: (ledger.schedule(phases, work, i, "head", "9", 1), work))
    return after.select("source_id", "phase", "status", "target", "epoch")


@_query
def ledger_claim_phase(t):
    after, _ = _few(t, lambda phases, work, i: (ledger.claim_phase(phases, work, i, "head", str(i % 4 + 1), i % 3, AS_OF), work))
    return after.select("source_id", "phase", "status", "started_at")


@_query
def ledger_finish_phase(t):
    def finish(phases, work, i):
        return ledger.finish_phase(phases, work, i, "head", "done" if i % 2 else "failed", str(i % 4 + 1), i % 3, AS_OF, completed="9", version="v", reason="time")

    after, work = _few(t, finish)
    both = after.where("phase = 'head'").select("source_id", "status", "completed", F.col("retry").alias("tries"))
    return both.join(work.select("source_id", F.col("status").alias("work_status"), "watermark", F.col("retry").alias("work_tries")), "source_id")


@_query
def ledger_control(t):
    """The control record after each of a list of actions."""
    state, rows = {"state": "ready", "epoch": 0, "stop_epoch": None, "requested_at": None, "finished_at": None}, []
    for n, (action, epoch) in enumerate([("admit", None), ("stop", None), ("stop", None), ("finish", 0), ("finish", 1), ("admit", None), ("stop", None), ("finish", 2)]):
        state = ledger.control(state, action, AS_OF, epoch)
        rows.append((n, action, state["state"], state["epoch"]))
    return t("region").sparkSession.createDataFrame(rows, "step int, action string, state string, epoch int")


@_query
def scan_budget(t):
    rows = t("lineitem").select(F.col("l_suppkey").cast("long").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("long").alias("bytes"))
    return ledger.within_budget(rows, "bytes", 15_000)[1]


@_query
def scoped_rescan(t):
    """One source's texts scanned anew for one rule: its findings are merged and lose their triage."""
    rows = with_tokens(t("documents")).select(
        F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("source_id"), F.concat(F.lit("p"), F.col("doc_id")).alias("path"), F.lit("path").alias("origin"), F.lit("s").alias("seq_id"), F.col("doc_id").alias("arrival"), "text"
    )
    rule = "aws_access_key_id"
    known = rows.where("arrival % 2 = 0").select("source_id", F.lit(rule).alias("rule_id"), F.col("path").alias("fingerprint"), "path", "origin", F.lit(1).alias("line_no"), F.lit(None).cast("string").alias("context_name"), "seq_id", "arrival", F.lit("valid").alias("triage"))
    after = rescan(known, rows, 3, rule, QUERY_KEY, AS_OF)
    return after.groupBy("source_id", "rule_id", "triage").agg(F.count(F.lit(1)).alias("n"))


@_query
def frozen_list_mismatches(t):
    rows = t("orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("id"))
    frozen = rows.where("position % 100 <> 7").withColumn("id", F.when(F.col("position") % 90 == 5, -F.col("id")).otherwise(F.col("id")))
    return findings.out_of_place(rows.where("position % 100 <> 9"), frozen)


@_query
def sorted_customers(t):
    return findings.page(findings.sorted_view(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", True, "c_custkey"), [F.desc(F.lower("c_mktsegment")), F.desc("c_custkey")], limit=50)


@_query
def incremental_rows(t):
    lines = t("lineitem").select(F.col("l_orderkey").cast("long").alias("source_id"), (F.col("l_partkey") % 1000).alias("seq"))
    return ledger.to_scan(lines, _work(t), ruleset_version()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


# Beyond: the batch form of the stream's windows


@_query
def windowed_events(t):
    from corpusguard.streaming.streams import windowed_counts

    return windowed_counts(t("events")).select("start", "event_type", "n", "total")
