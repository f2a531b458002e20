"""What security rules are about in public taxonomies, as a small table that findings are joined with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Categories of the 2021 list.
ACCESS, CRYPTO, INJECTION, CONFIGURATION = "A01:2021-Broken Access Control", "A02:2021-Cryptographic Failures", "A03:2021-Injection", "A05:2021-Security Misconfiguration"
IDENTIFICATION, INTEGRITY, FORGERY = "A07:2021-Identification and Authentication Failures", "A08:2021-Software and Data Integrity Failures", "A10:2021-Server-Side Request Forgery"
#: Weaknesses, category and severity of each rule.
TAXONOMY = {
    "security.sql-concatenation": (("CWE-89",), INJECTION, "high"),
    "security.disabled-ssl-verification": (("CWE-295",), CRYPTO, "high"),
    "security.unsafe-yaml-load": (("CWE-502",), INTEGRITY, "high"),
    "security.weak-crypto": (("CWE-327", "CWE-916"), CRYPTO, "medium"),
    "security.insecure-tls-protocol": (("CWE-326", "CWE-327"), CRYPTO, "high"),
    "security.flask-debug-enabled": (("CWE-489", "CWE-215"), CONFIGURATION, "high"),
    "security.github-actions-broad-permissions": (("CWE-272", "CWE-732"), ACCESS, "medium"),
    "security.github-actions-pull-request-target": (("CWE-94", "CWE-829"), INTEGRITY, "high"),
    "security.github-actions-remote-shell": (("CWE-494", "CWE-829"), INTEGRITY, "high"),
    "security.github-actions-secrets-in-pr": (("CWE-200", "CWE-522"), CONFIGURATION, "medium"),
    "security.github-actions-unpinned-action": (("CWE-1357", "CWE-829"), INTEGRITY, "medium"),
    "security.dependency-git-reference": (("CWE-829", "CWE-1357"), INTEGRITY, "medium"),
    "security.dependency-local-path": (("CWE-829",), INTEGRITY, "medium"),
    "security.dependency-url-reference": (("CWE-494", "CWE-829"), INTEGRITY, "medium"),
    "security.xxe": (("CWE-611", "CWE-776"), CONFIGURATION, "high"),
    "security.jinja2-autoescape-off": (("CWE-79",), INJECTION, "high"),
    "security.django-mark-safe": (("CWE-79",), INJECTION, "medium"),
    "security.django-raw-sql": (("CWE-89",), INJECTION, "high"),
    "security.paramiko-no-host-key-check": (("CWE-295", "CWE-322"), IDENTIFICATION, "high"),
    "security.hardcoded-bind-all-interfaces": (("CWE-668",), CONFIGURATION, "medium"),
    "security.insecure-temp-file": (("CWE-377", "CWE-379"), CONFIGURATION, "medium"),
    "security.cors-wildcard-with-credentials": (("CWE-942", "CWE-346"), CONFIGURATION, "high"),
    "security.hardcoded-framework-secret-key": (("CWE-798", "CWE-321"), CRYPTO, "high"),
    "security.ssrf": (("CWE-918",), FORGERY, "high"),
    "security.path-traversal": (("CWE-22",), ACCESS, "high"),
}


def with_taxonomy(findings: DataFrame) -> DataFrame:
    """Findings with ``metadata_json`` extended by their rule's weaknesses, categories and security severity, where it has any.

    The table is the library's, so it is broadcast whatever the input; other keys of the
    metadata stay, and come first.
    """
    spark = findings.sparkSession
    rows = spark.createDataFrame([(r, list(cwe), [owasp], severity) for r, (cwe, owasp, severity) in TAXONOMY.items()], "rule_id string, cwe array<string>, owasp array<string>, securitySeverity string")
    known = rows.select("rule_id", F.to_json(F.struct("cwe", "owasp", "securitySeverity")).alias("about"))
    joined = findings.join(F.broadcast(known), "rule_id", "left")
    own = F.regexp_replace("metadata_json", r"\}\s*$", "")
    both = F.when(own.rlike(r"^\s*\{\s*$"), F.col("about")).otherwise(F.concat(own, F.lit(","), F.expr("substring(about, 2)")))
    return joined.withColumn("metadata_json", F.when(F.col("about").isNull(), F.col("metadata_json")).otherwise(both)).select(findings.columns)
