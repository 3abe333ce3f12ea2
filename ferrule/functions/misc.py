"""Small expressions: addresses, lists, names, delays, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: types of threats found in code, roles by right. ----
CODE_THREATS = [
    "MALICIOUS_CODE", "WALLET_HIJACKING", "OBFUSCATED_CODE", "SUSPICIOUS_SCRIPT", "CRYPTO_MINING", "SUPPLY_CHAIN_ATTACK", "DATA_EXFILTRATION", "PATH_TRAVERSAL",
    "COMMAND_INJECTION", "DYNAMIC_REQUIRE", "SUSPICIOUS_MODULE", "OBFUSCATED_IOC", "SUSPICIOUS_DEPENDENCY", "MALICIOUS_CODE_STRUCTURE", "SUSPICIOUS_FILE",
    "DEPENDENCY_CONFUSION", "DEPENDENCY_CONFUSION_PATTERN", "DEPENDENCY_CONFUSION_ML_ANOMALY", "DEPENDENCY_CONFUSION_TIMELINE", "DEPENDENCY_CONFUSION_SCOPE",
    "DEPENDENCY_CONFUSION_ACTIVITY", "DEPENDENCY_CONFUSION_PREDICTIVE_RISK",
]
CODE_PREFIXES = ["ENHANCED_RULE_", "AGGREGATE_"]
RIGHTS = {"scan": ["admin", "analyst"], "webhooks": ["admin"], "audit": ["admin", "analyst"]}


def is_code_threat(kind: Column) -> Column:
    """A threat that code analysis found."""
    out = kind.isin(CODE_THREATS)
    for prefix in CODE_PREFIXES:
        out = out | kind.startswith(prefix)
    return out


def may(role: Column, right: str) -> Column:
    """Whether a role has a right."""
    return F.coalesce(role.isin(RIGHTS[right]), F.lit(False))


def repository(url: Column) -> Column:
    """owner/repo of a code-host address, without git+ and .git (F11); null for others."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^git\+", ""), r"\.git$", "")
    return F.nullif(F.regexp_extract(clean, r"github\.com[/:]([^/]+/[^/#?]+)", 1), F.lit(""))


def references(text: Column) -> Column:
    """Parts of a list split at commas and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def shortened(url: Column, most: int = 60) -> Column:
    """An address of at most ``most`` characters, the end as dots."""
    return F.when(F.length(url) > most, F.concat(F.substring(url, 1, most - 3), F.lit("..."))).otherwise(url)


def file_name(target: Column, stamp: Column) -> Column:
    """The file of a scan in the history (F15): its time and target, signs that paths use replaced."""
    place = F.substring(F.regexp_replace(target, r"[/\\]", "_"), 1, 50)
    return F.concat(F.regexp_replace(stamp, r"[:.]", "-"), F.lit("_"), F.coalesce(F.nullif(place, F.lit("")), F.lit("scan")), F.lit(".json"))


def delay(attempt: Column, base: float = 1.0, most: float = 30.0, limited: bool = False) -> Column:
    """Exponential back-off, steeper after a rate limit."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(4.0 if limited else 2.0), attempt))


def mentions_product(description: Column, package: Column, common: list[str]) -> Column:
    """Whether an advisory's prose is about the package (P20): as a whole word, and not for common words alone."""
    text, name = F.lower(description), F.lower(package)
    words = F.split(text, r"[^a-z0-9@/_-]+")
    return F.coalesce(F.array_contains(words, name) & ~name.isin(list(common) or [""]), F.lit(False))


def rate(amount: Column, milliseconds: Column) -> Column:
    """Amounts a second, rounded to two decimals; 0 without time."""
    return F.when(milliseconds > 0, F.floor(amount * 1000 / milliseconds * 100 + 0.5) / 100).otherwise(0.0)
