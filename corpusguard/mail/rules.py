"""Observations on a message and the status that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.text import is_host_or_subdomain, url_host

# Codes, what a request for credentials looks like, and sentences.
CREDENTIAL_REQUEST = (
    r"(?iu)(?:enter|send|provide).{0,80}(?:password|verification code|one.time code|otp)"
    r"|(?:введіть|надішліть|повідомте).{0,80}(?:пароль|код підтвердження|одноразовий код)"
)
CREDENTIAL, SENDER_LINK, LINK_LABEL = "credential_request", "sender_link_domain_mismatch", "link_label_mismatch"
LIMITATIONS = {
    "always": "The assessment looks at the visible parts of a message only and guarantees nothing.",
    "truncated": "The message's text was cut before the assessment.",
    "review": "The model gave an uncertain answer; look at this message.",
    "no_observations": "No particular signs were found in the fields given; that does not prove the message safe.",
}


def _web_host(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url_host(url))


def observations(message: Column) -> Column:
    """Codes, in a fixed order, of what is seen in a message struct."""
    domain = F.lower(F.get(F.split(message["sender"]["email"], "@"), F.lit(1)))
    domain = F.when(F.length(domain) > 0, domain)

    def foreign(link: Column) -> Column:
        host = _web_host(link["url"])
        return F.coalesce(~is_host_or_subdomain(host, domain), F.lit(False))

    def mislabelled(link: Column) -> Column:
        return F.coalesce(_web_host(link["url"]) != _web_host(F.trim(link["text"])), F.lit(False))

    links = F.coalesce(message["links"], F.array().cast("array<struct<text:string,url:string>>"))
    seen = F.array(
        F.when(F.coalesce(message["text"].rlike(CREDENTIAL_REQUEST), F.lit(False)), F.lit(CREDENTIAL)),
        F.when(F.exists(links, foreign), F.lit(SENDER_LINK)),
        F.when(F.exists(links, mislabelled), F.lit(LINK_LABEL)),
    )
    return F.filter(seen, lambda x: x.isNotNull())


def resolved(choice: Column, seen: Column, truncated: Column) -> Column:
    """A link whose label names another host is suspicious; a request for credentials,
    and a cut text, lift ``no_signals`` to ``review``; nothing else changes."""
    first = F.when(F.array_contains(seen, LINK_LABEL), "suspicious").when(F.array_contains(seen, CREDENTIAL) & (choice == "no_signals"), "review").otherwise(choice)
    return F.when(F.coalesce(truncated, F.lit(False)) & (first == "no_signals"), "review").otherwise(first)


def limitations(choice: Column, seen: Column, truncated: Column) -> Column:
    said = F.array(
        F.lit(LIMITATIONS["always"]),
        F.when(F.coalesce(truncated, F.lit(False)), LIMITATIONS["truncated"]),
        F.when(choice == "review", LIMITATIONS["review"]),
        F.when(F.size(seen) == 0, LIMITATIONS["no_observations"]),
    )
    return F.filter(said, lambda x: x.isNotNull())


def assess(df: DataFrame) -> DataFrame:
    """Adds ``observations``, ``status`` and ``limitations`` to rows with ``message``
    and the model's saved ``choice``; a choice that is no status is an error."""
    seen = df.withColumn("observations", observations(F.col("message")))
    truncated = F.col("message")["truncated"]
    choice = F.when(F.col("choice").isin("suspicious", "review", "no_signals"), F.col("choice"))
    out = seen.withColumn("status", F.coalesce(resolved(choice, F.col("observations"), truncated), F.lit("error")))
    out = out.withColumn("status", F.when(choice.isNull(), "error").otherwise(F.col("status")))
    return out.withColumn("limitations", limitations(choice, F.col("observations"), truncated))


def within_limits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose message keeps the field limits, and those that go to quarantine."""
    m = F.col("message")
    fits = (
        (F.length(m["sender"]["name"]) <= 200)
        & (F.length(m["sender"]["email"]) <= 320)
        & (F.length(m["subject"]) <= 500)
        & (F.length(m["text"]) <= 12_000)
        & (F.size(m["links"]) <= 30)
        & (F.size(m["attachments"]) <= 20)
        & F.forall(m["links"], lambda x: (F.length(x["text"]) <= 160) & (F.length(x["url"]) <= 2048))
    )
    ok = F.coalesce(fits, F.lit(False))
    return df.where(ok), df.where(~ok)
