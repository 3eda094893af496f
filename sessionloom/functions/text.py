"""Text measures, noise filters, secret and path redaction as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and patterns of the noise filters.
CONTROL = r"[\x01-\x08\x0B\x0C\x0E-\x1F]"
BASE64_RUN = r"(?:[A-Za-z0-9+/]{80,}={0,2}\s*){3,}"
LOG_LINE = r"^(?:\[[^\]]+\]|\d{4}-\d{2}-\d{2}[T ]|\w+:\s|at\s+\S+\s+\()"
DIFF_LINE = r"^(?:diff --git|index [a-f0-9]|@@ |\+\+\+ |--- |\+|-)"
GENERATED = r"(?i)\b(?:generated|auto-generated|do not edit|routeTree\.gen|package-lock\.json|pnpm-lock\.yaml|yarn\.lock)\b"
BOILERPLATE = r"^(Exit code:|Wall time:|Output:)(\W|$)"
SECRET_KEYS = ("api[_-]?key", "access[_-]?token", "auth[_-]?token", "secret", "password", "passwd", "pwd")
SECRET_SHAPES = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\b(?:sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
)
SAFE_SCHEMES = ("http", "https", "codex", "github")
PATH_MARK = "[local-path-redacted]"


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def clean(text: Column) -> Column:
    """Strip colour codes and command boilerplate lines; trim."""
    plain = F.regexp_replace(text, r"\x1B\[[0-9;]*m", "")
    return F.trim(F.array_join(F.filter(lines(plain), lambda x: ~F.trim(x).rlike(BOILERPLATE)), "\n"))


def normalize(text: Column) -> Column:
    """Collapse blanks and runs of empty lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n"))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def measures(text: Column) -> dict[str, Column]:
    """What the filters look at, by name."""
    rows = lines(text)
    filled = F.filter(F.transform(rows, F.trim), lambda x: x != "")
    blanks = F.regexp_count(text, F.lit(r"\s"))
    return {
        "n_chars": F.length(text),
        "n_lines": F.size(rows),
        "n_control": F.regexp_count(text, F.lit(CONTROL)),
        "blank_ratio": ratio(blanks, F.length(text)),
        "n_base64": F.regexp_count(text, F.lit("[A-Za-z0-9+/]{80,}")),
        "log_ratio": ratio(F.size(F.filter(rows, lambda x: F.trim(x).rlike(LOG_LINE))), F.size(rows)),
        "diff_ratio": ratio(F.size(F.filter(rows, lambda x: x.rlike(DIFF_LINE))), F.size(rows)),
        "n_filled": F.size(filled),
        "distinct_ratio": ratio(F.size(F.array_distinct(filled)), F.size(filled)),
    }


def filter_reason(text: Column, *, long_chars: int = 50_000, many_lines: int = 800, log_lines: int = 200, log_share: float = 0.7, diff_lines: int = 220, diff_chars: int = 20_000, diff_share: float = 0.35, generated_chars: int = 8_000, repeated_lines: int = 100, distinct_share: float = 0.25) -> Column:
    """The first reason to leave a text out of the index, null if there is none."""
    m = measures(text)
    compact = F.regexp_replace(text, r"\s+", "")
    binary = text.contains("\0") | ((m["n_control"] > 20) & (ratio(m["n_control"], m["n_chars"]) > 0.02))
    base64 = ((F.length(compact) > 300) & (m["blank_ratio"] < 0.02) & compact.rlike(r"^[A-Za-z0-9+/=]+$")) | text.rlike(BASE64_RUN)
    log = (m["n_chars"] > long_chars) | (m["n_lines"] > many_lines) | ((m["n_lines"] > log_lines) & (m["log_ratio"] > log_share))
    diff = ((m["n_lines"] > diff_lines) | (m["n_chars"] > diff_chars)) & (m["diff_ratio"] > diff_share)
    generated = (m["n_chars"] >= generated_chars) & (text.rlike(GENERATED) | ((m["n_filled"] >= repeated_lines) & (m["distinct_ratio"] < distinct_share)))
    return F.when(binary | base64, "binary_or_base64").when(log, "huge_raw_log").when(diff, "unbounded_diff").when(generated, "repeated_generated_file")


def obvious_secret(line: Column, keys: Iterable[str] = SECRET_KEYS) -> Column:
    """A line with a private key header, a key and value of 8 or more characters, or a vendor's key shape."""
    assigned = rf"""(?i)["']?\b(?:{'|'.join(keys)})\b["']?\s*[:=]\s*["']?(?!\[REDACTED\])[^\s"',}}\]]{{8,}}"""
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in (*SECRET_SHAPES, assigned)])


def drop_secret_lines(text: Column, keys: Iterable[str] = SECRET_KEYS) -> Column:
    keys = tuple(keys)
    return F.array_join(F.filter(lines(text), lambda x: ~obvious_secret(x, keys)), "\n")


def mask_structured(text: Column, keys: Iterable[str] = SECRET_KEYS) -> Column:
    """Quoted secret keys keep their name and lose their value."""
    pattern = rf"""(?i)(["'])({'|'.join(keys)})\1\s*:\s*(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^,\s}}\]]+)"""
    return F.regexp_replace(text, pattern, '$1$2$1:"[REDACTED]"')


def redact_patterns(text: Column, patterns: Iterable[tuple[str, str, bool]]) -> tuple[Column, Column]:
    """Apply (pattern, replacement, literal) in order: the text and the number of replacements."""
    hits = F.lit(0)
    for pattern, put, literal in patterns:
        expression = rf"\Q{pattern}\E" if literal else pattern
        hits = hits + F.regexp_count(text, F.lit(expression))
        text = F.regexp_replace(text, expression, put.replace("\\", "\\\\").replace("$", "\\$"))
    return text, hits


_STOP = r"""\s"',}\])\x02"""
_LEAD = r"""(^|[\s"'(\[{=,:])"""
#: What no path goes past (a safe address set aside among it), the characters of a name's end, and folders that are a path by themselves.
_PAST = r"""=\r\n"',}\])\x02"""
_WORD = "[A-Za-z0-9._@%+-]"
FOLDERS = ("home", "work", "Users", "Volumes", "private", "tmp", "var", "opt", "etc", "usr", "bin", "sbin", "lib", "lib64", "mnt", "media", "srv", "run", "root", "nix", "workspace", "app", "repo", "repos", "projects", "builds")


def _path(root: str, separator: str, folders: str, plain: str, past: str = _PAST, lead: str = _LEAD) -> str:
    """A path from its root on, with blanks in folder names. The last name has blanks too where it ends in an extension,
    or where the path stands between bounds (a quote, a bracket, a sign, an end); else it ends at a blank.

    Folders are read possessively, so that long paths need no stack. A folder name with an extension before a blank
    ends the path where nothing else does.
    """
    name, extension = f"[^{separator}{past}]", r"\.[A-Za-z0-9][A-Za-z0-9._-]*" + f"(?=$|[{_STOP}])"
    start = f"{root}(?:{name}++{separator}){folders}+"
    careful = rf"{root}(?:(?:(?!\.[A-Za-z0-9._-]++\s){name})++{separator}){folders}+{name}*{extension}"
    bounded = rf"""(?<=^|["'(\[{{=,:]){start}{name}*{_WORD}(?=$|[\r\n"',}}\])])"""
    return f"{lead}(?:{start}{name}*{extension}|{bounded}|{careful}|{start}{plain})"


#: By where a path starts: file addresses, shares, drives, folders from the root, known folders.
PATHS = (
    _path("file:///?", "/", "*", f"[^{_STOP}]*", lead=r"(\b)"),
    _path(r"\\\\", r"\\", "{2,}", f"[^{_STOP}]*"),
    _path(r"[A-Za-z]:\\", r"\\", "*", f"[^{_STOP}]*"),
    _path(f"/(?!/)(?={_WORD})", "/", "{1,}", f"{_WORD}*", past=":" + _PAST),
    _LEAD + rf"/(?:{'|'.join(FOLDERS)})\b[^{_STOP}]*",
)


def _safe(schemes: Iterable[str]) -> str:
    return rf"\b(?:{'|'.join(schemes)})://[^{_STOP}]+"


def redact_paths(text: Column, schemes: Iterable[str] = SAFE_SCHEMES) -> Column:
    """Local file paths become a mark; URIs of the safe schemes are set aside first and come back unchanged."""
    safe = _safe(schemes)
    uris = F.regexp_extract_all(text, F.lit(safe), F.lit(0))
    hidden = F.regexp_replace(text, safe, "\x02URI\x03")
    for pattern in PATHS:
        hidden = F.regexp_replace(hidden, pattern, "$1" + PATH_MARK)
    parts = F.split(hidden, "\x02URI\x03")
    joined = F.zip_with(parts, uris, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(joined, "")


_STRING = r'"(?:\\.|[^"\\])*"'


def redact_json(body: Column, schemes: Iterable[str] = SAFE_SCHEMES) -> Column:
    """Local paths in the string values of a JSON text at any depth; keys and everything else stay as they are.

    The text is cut at its string literals; a literal that a colon follows is a key.
    """
    schemes = tuple(schemes)
    literals = F.regexp_extract_all(body, F.lit(_STRING), F.lit(0))
    between = F.split(body, _STRING, -1)
    shown = F.transform(literals, lambda x, i: F.when(F.ltrim(F.get(between, i + 1)).startswith(":"), x).otherwise(redact_paths(x, schemes)))
    return F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def safe_locator(locator: Column, schemes: Iterable[str] = SAFE_SCHEMES) -> Column:
    """A locator only if it is one safe URI without a local path in it."""
    return F.when((redact_paths(locator, schemes) == locator) & locator.rlike(f"^{_safe(schemes)[2:]}$"), locator)


def snippet(text: Column, most: int = 240) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 1), F.lit("...")))


def fallback_text(body: Column, most: int = 4000) -> Column:
    return F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, most)


def part_text(part: Column) -> Column:
    """The searchable text of a content part struct (type, text, name, arguments, output, status)."""
    say = lambda *names: F.concat_ws(" ", *[F.when(part[n] != "", part[n]) for n in names])
    return F.when(part["type"] == "tool_call", say("name", "arguments", "status")).when(part["type"] == "tool_result", say("name", "output", "status")).otherwise(F.coalesce(part["text"], part["output"], part["arguments"], F.to_json(part)))


# --- chunks -------------------------------------------------------------------------------------------------
# Unsplit limit, target, least and overlap in tokens.
UNSPLIT, TARGET, LEAST, OVERLAP = 1200, 1000, 800, 125


def chunk_bounds(n: Column) -> Column:
    """Token ranges [a, b) of the overlapping chunks of a text with n tokens."""
    n = n.cast("int")
    count = F.greatest(F.lit(2), F.ceil((n - OVERLAP) / float(TARGET - OVERLAP)))
    size = F.least(F.lit(UNSPLIT), F.greatest(F.lit(LEAST), F.ceil((n + OVERLAP * (count - 1)) / count))).cast("int")
    size = F.when(n <= UNSPLIT, n).otherwise(size)
    stride = F.when(n <= UNSPLIT, F.greatest(n, F.lit(1))).otherwise(size - OVERLAP).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), stride), lambda s: (s == 0) | (s - stride + size < n))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.cast("int").alias("token_start"), F.least(s + size, n).cast("int").alias("token_end")))).otherwise(F.array().cast("array<struct<token_start:int,token_end:int>>"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


# --- retrieval ----------------------------------------------------------------------------------------------
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def analyzed(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def ordered_trigrams(text: Column) -> Column:
    """The padded word trigrams in their order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(grams)


def trigrams(text: Column) -> Column:
    """The set of padded word trigrams."""
    return F.array_distinct(ordered_trigrams(text))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
