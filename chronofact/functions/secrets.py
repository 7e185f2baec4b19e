"""Secret detection and redaction as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofact.functions.text import is_dangerous

#: Forms of secrets, (kind, pattern). No look-around, so that other engines can run them too.
PATTERNS = (
    ("private_key", r"-----BEGIN (?:[A-Z ]{0,39} )?PRIVATE KEY(?: BLOCK)?-----"),
    ("aws", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("openai", r"\bsk-[A-Za-z0-9_-]{16,}"),
    ("stripe", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,})"),
    ("gitlab", r"\bglpat-[A-Za-z0-9_-]{16,}"),
    ("npm", r"\bnpm_[A-Za-z0-9]{30,}"),
    ("slack", r"\bxox[a-z]-[A-Za-z0-9-]{10,}|hooks\.slack\.com/services/[A-Za-z0-9/]{16,}"),
    ("discord", r"discord(?:app)?\.com/api/webhooks/[0-9]{10,}/[A-Za-z0-9_-]{16,}"),
    ("google", r"\bAIza[A-Za-z0-9_-]{30,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_password", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s@/]+@"),
    ("signed_url", r"[?&]sig=[A-Za-z0-9%+/=_-]{16,}"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._-]{16,}"),
    ("assignment", r"""(?i)(?:api_?key|password|passwd|secret|token|credential|access_?key|session_id)["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.=-]{12,}"""),
)
#: A commit named as such is no secret; any other run of 40 hex digits is.
COMMIT = r"(?i)\bcommit [0-9a-f]{40}\b"
HEX = r"\b[0-9a-f]{40}\b"
#: Opaque words: this long, with both cases and a digit.
OPAQUE = r"\b[A-Za-z0-9]{28,}\b"

#: A text without any of these has none of the forms above.
HINT = r"(?i)-----BEGIN |akia|asia|sk[-_]|gh[pousr]_|github_pat_|glpat-|npm_|xox[a-z]-|hooks\.slack|discord|aiza|eyj|://|sig=|bearer|key|passw|secret|token|credential|session_id|[a-z0-9]{28}"


def contains_secret(text: Column) -> Column:
    """Whether any form stands in the text; texts without a hint of one are looked at once."""
    out = F.regexp_replace(text, COMMIT, "").rlike(HEX)
    for _, pattern in PATTERNS:
        out = out | text.rlike(pattern)
    opaque = F.exists(F.regexp_extract_all(text, F.lit(OPAQUE), F.lit(0)), lambda w: w.rlike("[A-Z]") & w.rlike("[a-z]") & w.rlike("[0-9]"))
    return F.coalesce(F.when(text.rlike(HINT), out | opaque), F.lit(False))


def fact_text(c: Callable[[str], Column]) -> Column:
    """All that a fact says, for scanners."""
    return F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in ("subject", "predicate", "object_str", "raw_quote", "tags_text")])


def safe_for_send(c: Callable[[str], Column], text: Column | None = None) -> Column:
    """No secret, by mark or by form; and no dangerous directive, unless low trust frames it as a claim."""
    text = fact_text(c) if text is None else text
    marked = F.coalesce(c("sensitivity").isin("secret", "credential"), F.lit(False))
    return ~marked & ~contains_secret(text) & ((c("trust_tier") == "low") | ~F.coalesce(is_dangerous(text), F.lit(False)))


def sensitivity(text: Column) -> Column:
    return F.when(contains_secret(text), "secret").otherwise("public")


def redact(text: Column) -> Column:
    """Each form replaced by [REDACTED:kind]."""
    for kind, pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text
