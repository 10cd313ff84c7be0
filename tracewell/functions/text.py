"""Row-local text functions: secret screening, evidence classes, tokens, estimates.

Patterns name ASCII classes instead of word boundaries, so that they mean the same in every
engine. All are column expressions; only texts with characters that normalise to others pass through
an Arrow function. Long patterns run only where one of their words occurs at all.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide a text's evidence class.
B, E = r"(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\))"
SECRET = (
    r"BEGIN\s+(?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED)\s+)?PRIVATE\s+KEY"
    rf"|{B}(?:bearer|basic)\s+\S+"
    rf"|{B}(?:gh[pousr]_|github_pat_|sk-)[A-Za-z0-9_-]{{8,}}"
    rf"|{B}(?:AKIA|ASIA)[A-Z0-9]{{16}}{E}"
    rf"|{B}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
    rf"|{B}(?:api[_-]?key|access[_-]?key|secret(?:[_-]?access[_-]?key)?|aws_secret_access_key|password|passwd|credential|token|authorization|cookie|client[_-]?secret|private[_-]?key)[\s\"']*[:=]"
    r"|://[^\s/:]+:[^\s/@]+@"
)
ZERO_FAILURES = rf"{B}0\s+(?:failures?|failed|errors?){E}"
FAILURE = rf"{B}(?:error|fatal|fail(?:ed|ure)?|failures|exception|panic|crash(?:ed)?|AssertionError){E}|Traceback \(most recent call last"
SECURITY = rf"{B}(?:CVE-\d{{4}}-\d+|vulnerabilit[a-z]*|security\s+(?:finding|policy|scan)|adversarial\s+test){E}|BEGIN\s+(?:PUBLIC|CERTIFICATE)"
AUTHORITY = rf"{B}IAM{E}.*{B}policy{E}|{B}permissions?\s+(?:denied|granted){E}|{B}signed\s+by{E}|{B}audit\s+log{E}"
WARNING = rf"{B}(?:warn(?:ing)?|deprecated|DeprecationWarning|truncat(?:ed|ion)|incomplete){E}"
CANONICAL = rf"(?m)^commit [0-9a-f]{{7,40}}|^On branch \S+|^HEAD detached|^nothing to commit|{B}SHA-?(?:256|1)\s*[:=]\s*[0-9a-f]{{40,64}}{E}"
BENCHMARK = rf"{B}benchmark{E}|{B}\d+\.\d+\s*ms{E}.*{B}(?:mean|median|p50|p95|p99){E}"
SUCCESS = rf"(?m){B}\d+\s+passed{E}|{B}all\s+tests?\s+pass(?:ed)?{E}|{B}OK\s*\(\s*\d+\s+test|^\d+ tests?, 0 failures?$"
DISCOVERY = r"(?m)^(?:total\s+\d+|drwx|lrwx|-rw)|^\s*(?:├──|└──|│)|Directory of "
CONTROL = r"[\x01-\x08\x0b\x0c\x0e-\x1f]"
NOISE_LINE = r"(?:Building\.\.\.\s*\[\s*OK\s*\]|[.]{1,80}|\[#+ *\])"
PROGRESS_LINE = r"(?:Downloading\s+(?:100|[1-9]?\d)%|(?:100|[1-9]?\d)%\|[ #=|.> -]*)"
FACT = r"(?m)^(?:commit [0-9a-f]{7,40}|On branch \S+)"

# Words one of which stands, in lower case, in every text that its pattern matches.
WORDS = {
    SECRET: (
        "private", "bearer", "basic", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "akia", "asia", "eyj", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key",
        "secret", "passw", "credential", "token", "authorization", "cookie", "://",
    ),
    FAILURE: ("error", "fatal", "fail", "exception", "panic", "crash", "traceback"),
    SECURITY: ("cve-", "vulnerabilit", "security", "adversarial", "begin"),
    AUTHORITY: ("iam", "permission", "signed", "audit"),
    WARNING: ("warn", "deprecat", "truncat", "incomplete"),
    CANONICAL: ("commit ", "on branch", "head detached", "nothing to commit", "sha1", "sha-1", "sha256", "sha-256"),
    BENCHMARK: ("benchmark", "ms"),
    SUCCESS: ("pass", "ok", "tests, 0", "test, 0"),
    DISCOVERY: ("total", "drwx", "lrwx", "-rw", "├──", "└──", "│", "directory of"),
}

# Words that carry no meaning for ranking.
STOPWORDS = (
    "a", "an", "the", "and", "or", "not", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "this", "that", "these", "those", "for", "in", "on", "at", "to", "of", "with", "from", "by", "as", "it", "its", "if", "but", "so", "up", "out", "all", "no", "into", "than", "then", "over", "more", "also", "about",
    "any", "each", "which", "when", "what", "where", "how", "who", "use", "used", "using", "new", "get", "set", "add", "run", "via", "per", "see", "now", "fix",
)
SEPARATORS = r"[\\/.\s,;:'\"()\[\]{}<>=!|&^%$#@~`+\-*]+"
# Suffixes of the older stemmer, first match wins.
SUFFIXES = ("ing", "ion", "ed", "er", "ly", "tion", "ness", "ment")


@cache
def _compatible() -> str:
    """A character class of everything that compatibility normalisation may turn into ASCII, and of marks.

    Ranges with small gaps are joined, so that the class is short; it may hold more than it needs to. ASCII is ruled out first, by one
    comparison a character.
    """
    runs: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000 or not any(x.isascii() for x in unicodedata.normalize("NFKC", chr(c))):
            continue
        if runs and c - runs[-1][1] <= (4 if c < 0x300 else 1024):
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"[\x{80}-\x{10ffff}&&[\p{M}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]]"


@cache
def _nfkc():
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run


def scan_text(text: Column) -> Column:
    """The text without terminal controls, in compatibility form; invalid bytes are replaced."""
    valid = F.make_valid_utf8(text)
    plain = F.when(F.contains(valid, F.lit("\x1b")), F.regexp_replace(valid, ANSI, "")).otherwise(valid)
    odd = F.when(plain.rlike(_compatible()), plain)
    return F.coalesce(_nfkc()(odd), plain)


def _seen(text: Column, result) -> Column:
    """``result`` of the scanned text and its lower case, which are computed once."""
    one = F.transform(F.array(scan_text(text)), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
    return F.get(F.transform(one, lambda s: result(s["text"], s["low"])), F.lit(0))


def _holds(low: Column, pattern: str) -> Column:
    out = F.lit(False)
    for w in WORDS[pattern]:
        out = out | low.contains(w)
    return out


def _has(seen: Column, low: Column, pattern: str) -> Column:
    return _holds(low, pattern) & seen.rlike("(?i)" + pattern)


def contains_sensitive(text: Column) -> Column:
    """Null for null."""
    return F.when(text.isNotNull(), _seen(text, lambda seen, low: _has(seen, low, SECRET)))


def lines_of(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    lines = F.split(text, r"\r\n|\n|\r")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def evidence_class(text: Column, exit_code: Column) -> Column:
    """The first class that fits, in the order of danger; unknown if none does."""

    def of(seen: Column, low: Column) -> Column:
        has = lambda pattern: _has(seen, low, pattern)
        # only texts whose first line is of the grammar are split into lines
        opens = lambda pattern: seen.rlike(f"(?i)^(?:{pattern})(?:[\\r\\n]|$)")
        every = lambda test: F.forall(lines_of(seen), test)
        is_noise = lambda x: x.rlike("^" + NOISE_LINE + "$")
        noise = opens(NOISE_LINE) & every(is_noise)
        progress = opens(NOISE_LINE + "|" + PROGRESS_LINE) & every(lambda x: is_noise(x) | x.rlike("(?i)^" + PROGRESS_LINE + "$"))
        structured = F.trim(seen).rlike(r"^[\[{]")
        return (
            F.when(has(SECRET), "SECURITY")
            .when(_holds(low, FAILURE) & F.regexp_replace(seen, "(?i)" + ZERO_FAILURES, " ").rlike("(?i)" + FAILURE), "FAILURE")
            .when(has(SECURITY), "SECURITY")
            .when(has(AUTHORITY), "AUTHORITY")
            .when(has(WARNING), "DIAGNOSTIC")
            .when(has(CANONICAL), "CANONICAL_STATE")
            .when(has(BENCHMARK), "BENCHMARK")
            .when(is_binary(text), "MACHINE_DATA")
            .when(structured & F.try_parse_json(F.trim(seen)).isNotNull(), "MACHINE_DATA")
            .when(structured & ~noise, "UNKNOWN")
            .when(has(SUCCESS), "SUCCESS_SUMMARY")
            .when(has(DISCOVERY), "DISCOVERY")
            .when(text.rlike(CONTROL), "UNKNOWN")
            .when(noise, "NOISE")
            .when(progress, "PROGRESS")
            .otherwise("UNKNOWN")
        )

    return F.when(exit_code != 0, "FAILURE").when(text.isNull() | (F.octet_length(text) == 0), "UNKNOWN").otherwise(_seen(text, of))


def is_binary(text: Column) -> Column:
    """A NUL or bytes that are not UTF-8."""
    return F.contains(text, F.lit("\0")) | ~F.is_valid_utf8(text)


def required_facts(text: Column) -> Column:
    """Commit and branch lines that must stay visible."""
    return F.regexp_extract_all(text, F.lit(FACT), F.lit(0))


def occurrences(text: Column, fact: Column) -> Column:
    """Non-overlapping literal occurrences."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, fact, F.lit("")))) / F.octet_length(fact)).cast("long")


def token_estimate(n_bytes: Column) -> Column:
    """A quarter of the bytes: an estimate, never a token count."""
    return n_bytes / 4.0


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of identifiers, split at separators, underscores and case changes, in order."""
    snake = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    words = F.split(F.lower(F.regexp_replace(snake, SEPARATORS, "_")), "_")
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOPWORDS))


def stem(word: Column) -> Column:
    out = None
    for s in SUFFIXES:
        fits = word.endswith(s) & (F.char_length(word) - len(s) >= 3)
        cut = F.substring(word, F.lit(1), F.char_length(word) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def stems(text: Column) -> Column:
    """Distinct stems of words of three letters or more."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOPWORDS)), stem))
