"""Ownership, role and ranking of addresses, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import emails as E


def ranked_emails(sites: DataFrame, domain: str = "domain", emails: str = "emails",
                  mailto: str = "mailto_emails") -> DataFrame:
    """Adds ``ranked_own`` and ``ranked_other``: structs, best contact first.

    One site is one row, so ranking sorts small arrays and shuffles nothing.
    """
    return sites.withColumn("ranked_own", E.ranked(E.own_emails(emails, domain), mailto)).withColumn(
        "ranked_other", E.ranked(E.other_emails(emails, domain), mailto)
    )


def primary_of(own: Column, other: Column) -> Column:
    """Best own address, else best other one; null when there is none."""
    return F.coalesce(F.get(own, F.lit(0)), F.get(other, F.lit(0)))


def drop_blocked_domains(emails: DataFrame, blocked: DataFrame, email: str = "email") -> DataFrame:
    """Rows whose domain is not equal to or under a domain of a ``blocked(domain)`` table.

    Each address domain is unfolded into its suffixes once, so the test is an
    equality join whatever the size of the table.
    """
    domains = emails.select(E.email_domain(email).alias("_domain")).distinct()
    labels = F.split("_domain", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hit = (
        domains.select("_domain", F.explode(suffixes).alias("_suffix"))
        .join(blocked.select(F.lower("domain").alias("_suffix")).distinct(), "_suffix", "left_semi")
        .select("_domain").distinct()
    )
    return emails.withColumn("_domain", E.email_domain(email)).join(hit, "_domain", "left_anti").drop("_domain")


def mx_filter(sites: DataFrame, mx: DataFrame, key: str, emails: str = "emails") -> DataFrame:
    """Drop addresses whose domain is known to have no mail server; unknown domains stay.

    Only known-bad domains are joined, and sites without such an address are
    not rebuilt.
    """
    bad = mx.filter(F.col("has_mx") == F.lit(False)).select(F.col("domain").alias("_mx")).distinct()
    hit = (
        sites.select(key, F.explode(emails).alias("_email"))
        .withColumn("_mx", E.mx_domain("_email"))
        .join(bad, "_mx", "left_semi")
        .groupBy(key).agg(F.collect_set("_email").alias("_bad"))
    )
    return (
        sites.join(hit, key, "left")
        .withColumn(emails, F.when(F.col("_bad").isNull(), F.col(emails)).otherwise(F.array_except(emails, "_bad")))
        .drop("_bad")
    )


def drop_personal(sites: DataFrame, emails: str = "emails") -> DataFrame:
    """Remove addresses that point to a person."""
    return sites.withColumn(emails, F.filter(emails, lambda e: E.email_role(e) != "personal"))


def hashed_personal(email: Column, role: Column, salt: str) -> Column:
    """Personal addresses with the local part replaced by a salted hash."""
    hashed = F.concat(
        F.sha2(F.concat(F.lit(salt), email), 256), F.lit("@"), E.email_domain(email)
    )
    return F.when(role == "personal", hashed).otherwise(email)


def email_dictionary(results: DataFrame) -> DataFrame:
    """One row per site and address: role, owner flag, mailto flag."""
    rows = results.select("input_url", "domain", "mailto_emails", F.explode("emails").alias("email"))
    return rows.select(
        "input_url", "domain", "email",
        E.email_role("email").alias("role"),
        E.belongs_to("email", "domain").alias("is_own"),
        F.array_contains("mailto_emails", F.col("email")).alias("from_mailto"),
    )
