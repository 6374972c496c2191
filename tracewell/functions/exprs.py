"""Column functions: text, hashes, vectors, evidence mathematics, JSON and arrays.

"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

# The redaction patterns, in the order in which they are applied.
PEM = r"-----BEGIN [A-Z ]*(?:PRIVATE KEY|SECRET KEY)[\s\S]*?-----END [A-Z ]*(?:PRIVATE KEY|SECRET KEY)-----"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?1[-.\s])?(?:\(?\d{3}\)?[-.\s])\d{3}[-.\s]\d{4}\b"
TOKEN = r"\bsk-[A-Za-z0-9_-]{12,}|\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{12,}\b|\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}\b|\bxox[baprs]-[A-Za-z0-9-]{8,}|\bya29\.[A-Za-z0-9_-]{8,}|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
JWT = r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"
BEARER = r"(?i)(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}"
CREDENTIAL_URL = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/@:]+:[^\s/@]+@[^\s]+"
ASSIGNMENT_KEY = r"(?:api[_-]?key|secret|password|token|credential|authorization|private[_-]?key)"
ASSIGNMENT = rf"""(?i)["'`]?\b{ASSIGNMENT_KEY}\b["'`]?\s*[:=]\s*(?:"(?:\\.|[^"\\\r\n])*"|'(?:\\.|[^'\\\r\n])*'|`(?:\\.|[^`\\\r\n])*`|[^\s,;}}\]]+)"""
HOME_PATH = r"""(?:~/|/(?:home|Users|var/folders|tmp|media|mnt|Volumes)/[^\s"']+|[A-Za-z]:\\Users\\[^\s"']+)"""
REDACTIONS = (PEM, EMAIL, PHONE, TOKEN, JWT, BEARER, CREDENTIAL_URL, ASSIGNMENT, HOME_PATH)
REDACTED_ASSIGNMENT = rf"""(?i)["'`]?\b{ASSIGNMENT_KEY}\b["'`]?\s*[:=]\s*["'`]?\[REDACTED\]["'`]?"""
PEM_HEAD = r"-----BEGIN [A-Z ]*(?:PRIVATE KEY|SECRET KEY)"
#: What a text has if any of the redactions finds anything in it; most texts lack all of it.
SUSPECT = r"(?i)@|://|-----BEGIN|\d{3}[-.\s]\d{4}|sk-|[spr]k_|gh[pousr]_|github_pat_|xox[baprs]-|ya29\.|AKIA|ASIA|[A-Za-z0-9_-]{20}\.|(?:Bearer|Basic)\s|(?:key|secret|password|token|credential|authorization)[\"'`]?\s*[:=]|~/|/(?:home|Users|var/folders|tmp|media|mnt|Volumes)/|:\\Users\\"
# What counts as white space in wording.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SENSITIVE_KEY = r"(?i)(?:token|api[_-]?key|secret|password|authorization|private[_-]?key|credential|path|file)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


# --- text -----------------------------------------------------------------


def norm_text(c: Column) -> Column:
    """[X1] Trimmed, white space (Unicode's too) collapsed, lower case; null is empty."""
    return F.lower(collapsed(F.coalesce(c, F.lit(""))))


def collapsed(c: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def embedding_inputs(condition: Column, behavior: Column) -> Column:
    """[X2] The two prefixed inputs and the legacy joint one."""
    return F.struct(
        F.concat(F.lit("condition: "), norm_text(condition)).alias("condition"),
        F.concat(F.lit("behavior: "), norm_text(behavior)).alias("behavior"),
        F.concat_ws("\n", norm_text(condition), norm_text(behavior)).alias("joint"),
    )


def redact(c: Column) -> Column:
    """[X3] Nine substitutions in a fixed order, for the texts that have anything that one of them looks for."""
    safe = c
    for pattern in REDACTIONS:
        safe = F.regexp_replace(safe, pattern, REDACTED)
    return F.when(c.rlike(SUSPECT), safe).otherwise(c)


def sensitive(c: Column) -> Column:
    """Whether any family of secrets or personal data is left in a text; key heads and home paths count in any case."""
    c = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(c, REDACTED_ASSIGNMENT, REDACTED).rlike(ASSIGNMENT)
    for p in ("(?i)" + PEM_HEAD, EMAIL, PHONE.removesuffix(r"\b"), TOKEN, JWT, BEARER, CREDENTIAL_URL, "(?i)" + HOME_PATH):
        out = out | c.rlike(p)
    return c.rlike(SUSPECT) & out


def canonical_json(**columns: Column) -> Column:
    """[X5] JSON of the named columns with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def checksum(c: Column) -> Column:
    """[X6] Hex SHA-256 of a text or of canonical JSON."""
    return F.sha2(c, 256)


def stable_id(prefix: str, value: Column) -> Column:
    """[X7] ``prefix-`` and 40 hex digits."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(checksum(value), 1, 40))


def identity(version: str, *parts: Column) -> Column:
    """[X8] Versioned identity hash of normalised parts."""
    return checksum(F.concat_ws("\n", F.lit(version), *(norm_text(p) for p in parts)))


def event_fingerprint(*parts: Column) -> Column:
    """[X9] Hash of scope, entries, episode and content, which no part can run into the next."""
    return checksum(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def pair_key(a: Column, b: Column) -> Column:
    """[X10] The two ids in order, joined by NUL."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat(F.least(a, b), F.lit("\0"), F.greatest(a, b))


def token_set(c: Column) -> Column:
    """[X11] Distinct lower-case alphanumeric tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(norm_text(c), r"[^a-z0-9]+"), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """[X12] Shared over all elements; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def utf8_prefix(c: Column, n: int) -> Column:
    """[X23] The longest prefix of whole characters within ``n`` bytes, trimmed at its end."""
    head = F.substring(c.cast("binary"), 1, n)
    # a character has at most four bytes, so one of these cuts leaves none open
    whole = lambda h: F.coalesce(*(F.try_validate_utf8(F.substring(h, F.lit(1), F.octet_length(h) - k).cast("string")) for k in range(4)))
    return F.regexp_replace(F.when(F.octet_length(c) <= n, c).otherwise(let(head, whole)), r"\s+$", "")


def head_tail(c: Column, n: int) -> Column:
    """[X24] First and last halves of a text longer than ``n``."""
    head = n // 2
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(" "), F.right(c, F.lit(n - head))))


def tail_keep(c: Column, n: int, marker: str = "[truncated]\n") -> Column:
    """[X25] A marker and the last characters of a long text."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.lit(marker), F.right(c, F.lit(n - len(marker)))))


def truncated(c: Column, n: int) -> Column:
    """[X26] Redacted, cut to ``n`` characters and an ellipsis."""
    safe = redact(c)
    return F.when(F.length(safe) <= n, safe).otherwise(F.concat(F.substring(safe, 1, n), F.lit("…")))


def json_part(c: Column) -> Column:
    """[X27] The JSON inside a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).otherwise(braces)


# A tool's record in a turn, and how much of turns, names, payloads and replies a behaviour query takes.
TOOL_HEAD = r"\[tool_(?:call|result|error):"
TOOL_SPAN = rf"(?is)\[tool_(call|result|error):([^\]\r\n]{{1,120}})\]{SPACE}*(.*?)(?={TOOL_HEAD}|\z)"
REQUEST_LINE = rf"(?i)(?:^|{SPACE})Request:{SPACE}*[^\n]*"
TURN_CHARS, TOOL_SPANS, TOOL_NAME_CHARS, EDGE_CHARS, QUERY_TOKENS = 24_000, 8, 120, 1_200, 128


def behavior_source(turn: Column) -> Column:
    """[X28] What a turn did: its last eight tool records, newest first, then the reply's tail and head.

    ``turn`` is made of ``message_part`` texts.  It is cut to its ends and
    redacted; null if a secret is left or nothing remains.
    """

    def told(span: Column) -> Column:
        kind, name, payload = (F.regexp_extract(span, TOOL_SPAN, n) for n in (1, 2, 3))
        bounded = let(collapsed(payload), lambda p: head_tail(p, EDGE_CHARS))
        return collapsed(F.concat_ws(" ", F.lit("tool"), kind, F.substring(collapsed(name), 1, TOOL_NAME_CHARS), bounded))

    def lines(safe: Column) -> Column:
        newest = let(F.regexp_extract_all(safe, F.lit(TOOL_SPAN), F.lit(0)), lambda found: F.reverse(F.slice(found, F.greatest(F.size(found) - TOOL_SPANS + 1, F.lit(1)), F.lit(TOOL_SPANS))))
        reply = collapsed(F.regexp_replace(F.regexp_replace(safe, TOOL_SPAN, " "), REQUEST_LINE, " "))
        said = lambda part: F.concat(F.lit("assistant action "), part)
        ends = lambda r: F.array(F.when(r["tail"] != "", said(r["tail"])), F.when((r["head"] != "") & (r["head"] != r["tail"]), said(r["head"])))
        edges = let(reply, lambda r: F.struct(F.right(r, F.lit(EDGE_CHARS)).alias("tail"), F.substring(r, 1, EDGE_CHARS).alias("head")))
        return F.array_join(F.concat(F.transform(newest, told), let(edges, ends)), "\n")

    return let(let(turn, lambda t: redact(head_tail(t, TURN_CHARS))), lambda safe: F.when(~sensitive(safe), F.nullif(lines(safe), F.lit(""))))


def within_tokens(c: Column, tokenizer: str, most: int = QUERY_TOKENS) -> Column:
    """[X28] The longest prefix that is ``most`` tokens at most of a ``tokenizers`` file, special ones included, white space collapsed; null if none is left."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        special = len(coder.encode("").ids)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            ids = coder.encode(text, add_special_tokens=False).ids[: most - special]
            while ids:
                cut = " ".join(coder.decode(ids).rstrip("\ufffd").split())
                if len(coder.encode(cut).ids) <= most:
                    return cut or None
                ids.pop()
            return None

        return texts.map(one)

    return run(c)


def behavior_query(turn: Column, tokenizer: str, most: int = QUERY_TOKENS) -> Column:
    """[X28] ``behavior_source`` within a budget of tokens."""
    return within_tokens(behavior_source(turn), tokenizer, most)


@F.pandas_udf(T.StringType())
def _compatible_lower(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def key_text(c: Column) -> Column:
    """[X29] Compatible forms, lower case, everything but ASCII letters and digits as single spaces; only other than ASCII texts leave the JVM."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    lower = F.when(plain, F.lower(c)).otherwise(_compatible_lower(F.when(~plain, c)))
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def xml_escape(c: Column) -> Column:
    """[X30] The five entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def json_prefix(c: Column, n: int) -> Column:
    """[X31] The longest prefix whose JSON string is at most ``n`` characters, by halving steps: longer prefixes have longer strings."""
    quoted = lambda k: F.length(F.to_json(F.array(F.substring(c, F.lit(1), k)))) - 2
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    longest = F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= F.length(c)) & (quoted(k + s) <= n), k + s).otherwise(k))
    return F.substring(c, F.lit(1), longest)


def declared_wording(c: Column, longest: int = 2000) -> Column:
    """[X32] Redacted, trimmed, collapsed; null where control characters forbid it, or over ``longest`` before or half of that after, or if nothing is left."""
    bad = (F.length(c) > longest) | c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    wording = F.when(~bad, collapsed(redact(c)))
    return F.when(F.length(wording).between(1, longest // 2), wording)


def provider_model(c: Column) -> Column:
    """[X33] ``provider/model`` split at the first slash; null unless both parts are there, without ``..`` or a null character."""
    at = F.instr(c, "/")
    parts = F.struct(F.substring(c, F.lit(1), at - 1).alias("provider"), F.substring(c, at + 1, F.length(c)).alias("model_id"))
    return F.when((at > 1) & (at < F.length(c)) & ~F.contains(parts["provider"], F.lit("..")) & ~parts["model_id"].rlike(r"\.\.|\x00"), parts)


def user_id(c: Column) -> Column:
    """[X34] Trimmed, blank to ``owner``; null where separators or controls make it unsafe."""
    name = F.coalesce(F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")), F.lit("owner"))
    return F.when(~name.rlike(r"[/\\\x00-\x1f\x7f]"), name)


def visible_text(parts: Column, content: Column | None = None, display: Column | None = None) -> Column:
    """[X35] A message's plain ``content``, or else its text ``parts`` (``type, text``) joined without a break; empty if it is not displayed."""
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    text = F.coalesce(text if content is None else F.coalesce(content, text), F.lit(""))
    return text if display is None else F.when(display.eqNullSafe(False), "").otherwise(text)


def bounded_json(c: Column, longest: int) -> Column:
    """[X36] Redacted JSON; null where it is too long or a secret is left."""
    safe = redact(c)
    return F.when((F.length(safe) <= longest) & ~sensitive(safe), safe)


# Fixed value: the line above the guidance.
GUIDANCE_HEAD = "Agent Experience approved habit guidance (bounded; not policy/law):"


def guidance(habits: Column, longest: int = 2000) -> Column:
    """[X37] A heading and two lines for each of the first three habits (``condition, behavior``), in their order; null if a secret is in them."""
    lines = F.transform(F.slice(habits, 1, 3), lambda h: F.concat(F.lit("- When: "), h["condition"], F.lit("\n  Do: "), h["behavior"]))
    text = F.substring(F.array_join(F.concat(F.array(F.lit(GUIDANCE_HEAD)), lines), "\n"), 1, longest)
    return F.when(~sensitive(text), text)


def prompt_input(c: Column) -> Column:
    """[X39] A normalised, non-empty prompt of at most 5 000 characters; null if empty."""
    return F.nullif(F.substring(norm_text(c), 1, 5000), F.lit(""))


def message_part(kind: Column, text: Column, name: Column, arguments: Column | None = None, failed: Column | None = None) -> Column:
    """[X41] One block of a message as text: texts and thoughts as they are, calls with their redacted JSON ``arguments``, results and errors with their text."""
    from tracewell.functions.free_json import redact_json

    given = F.lit("") if arguments is None else F.coalesce(redact_json(arguments), F.lit(""))
    head = F.lit("[tool_result:") if failed is None else F.when(failed, "[tool_error:").otherwise("[tool_result:")
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(kind.isin("text", "thinking"), text)
        .when(kind == "tool_call", F.concat(F.lit("[tool_call:"), F.coalesce(name, F.lit("tool")), F.lit("] "), given))
        .when(kind == "tool_result", F.concat(head, F.coalesce(name, F.lit("tool")), F.lit("] "), text))
        .otherwise("")
    )


# --- vectors --------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """[X13] Cosine similarity; null where lengths differ, a norm is zero or a value is not finite.

    Norms that are known already spare two of three products a pair.
    """
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    fits = lambda n: (F.size(a) == F.size(b)) & (n > 0) & (n < float("inf"))
    return F.transform(F.array(norms), lambda n: F.when(fits(n), dot(a, b) / n))[0]


def basis_points(similarity: Column) -> Column:
    """[X14] Ten-thousandths, truncated towards zero."""
    return (similarity * 10000).cast("bigint")


def unit(v: Column) -> Column:
    """[X15] L2-normalised, in single precision; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))


def field_min(a: Column, b: Column) -> Column:
    """[X16] The weaker of two fields' similarities, within bounds, for duplicates."""
    return F.greatest(F.lit(-10000), F.least(F.lit(10000), a, b))


def field_max(a: Column, b: Column) -> Column:
    """[X16] The stronger one, for retrieval."""
    return F.greatest(a, b)


def similarity_class(bp: Column, review: int, strong: int) -> Column:
    """[X17]"""
    return F.when(bp >= strong, "strong").when(bp >= review, "review").otherwise("none")


@F.pandas_udf(T.BinaryType())
def vector_blob(v: pd.Series) -> pd.Series:
    """[X22] Little-endian single-precision values, four bytes each."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _floats(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


def blob_vector(b: Column, dimensions: int) -> Column:
    """[X22] The vector of a blob; null where its size is not that of ``dimensions`` values."""
    return _floats(F.when(F.octet_length(b) == 4 * dimensions, b))


# --- evidence -------------------------------------------------------------


def staleness(days: Column, contradictions: Column, decay: float = 0.05, k: float = 1.0) -> Column:
    """[X19] ``1 - (1 - decay)**days / (1 + k * contradictions)`` within [0, 1)."""
    if not 0 < decay < 1 or k < 0:
        raise ValueError("decay must be within (0, 1) and k not negative")
    whole = lambda c: F.greatest(F.lit(0.0), F.floor(c).cast("double"))
    value = 1 - F.pow(F.lit(1 - decay), whole(days)) / (1 + F.lit(k) * whole(contradictions))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1 - 2.0**-52))


def utc_day(ts: Column) -> Column:
    """[X20] The date in UTC (the session's time zone is UTC)."""
    return F.to_date(ts)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_iso(c: Column) -> Column:
    """[X21] Whether a text is a time in its canonical form."""
    return F.coalesce(iso(F.try_to_timestamp(c)) == c, F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    """[X18, X40] A number within bounds."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
