"""What a shell command does: its family, whether it writes, and what a read shows.

Column expressions over command text; first match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each family looks like, in order of precedence.
WRITES = r"WriteAllText|Set-Content|Out-File|apply_patch|git apply|patch |(?i:\b(?:apply_patch|git apply|patch|Set-Content|Out-File)\b)"
REDIRECT, PYTEST = r"(?:^|[^\d])>[^>]", r"\b(?:pytest|python -m pytest)\b"
FAMILIES = (
    ("TEST", r"\b(?:pytest|python -m pytest|python -m unittest|npm test|cargo test|ctest)\b"),
    ("BUILD", r"\b(?:python -m compileall|cargo build|npm run build|make)\b"),
    ("SEARCH", r"^(?:rg|grep|git grep|findstr)\b"),
    ("FILE_READ", r"(?i)\b(?:Get-Content|cat|head|tail|type|more|less)\b"),
    ("DIRECTORY_LIST", r"(?i)\b(?:Get-ChildItem|dir|ls|tree)\b"),
    ("GIT", r"^git\b"),
    ("SCRIPT", r"^(?:python|node|bash|sh|powershell|pwsh|\./|wsl\.exe)\b"),
    ("OTHER", r"(?i)^(?:echo|cd|pwd|which|where|sleep|Start-Sleep|gcloud|Get-Process|Get-CimInstance)\b"),
)
GIT_WRITES = r"\b(?:commit|merge|rebase|cherry-pick|revert)\b"
#: The word after the first semicolon that one follows; only a few count as a command of their own.
SECOND, SECOND_WORDS = r";\s*([a-zA-Z0-9_.-]+)\b", ("git", "pytest", "rg", "get-content", "get-childitem")


def writes_files(command: Column) -> Column:
    return command.rlike(WRITES) | (command.rlike(REDIRECT) & ~command.rlike(PYTEST))


def _first_family(command: Column, otherwise: Column) -> Column:
    out = F.when(writes_files(command), "WRITE_OR_EDIT")
    for name, pattern in FAMILIES:
        out = out.when(command.rlike(pattern), name)
    return out.otherwise(otherwise)


def _second_command(command: Column) -> Column:
    """What follows the semicolon, if its first word counts. No deeper command can: the words that count
    are either families of their own wherever they stand, or open the rest."""
    word = F.lower(F.regexp_extract(command, SECOND, 1))
    return F.when(word.isin(*SECOND_WORDS), F.trim(F.regexp_extract(command, r"(?s);(\s*[a-zA-Z0-9_.-]+\b.*)", 1)))


def family(command: Column) -> Column:
    tidy = F.trim(command)
    second = _second_command(tidy)
    return F.when(tidy.isNull() | (tidy == ""), "UNKNOWN").otherwise(_first_family(tidy, F.when(second.isNotNull(), _first_family(second, F.lit("UNKNOWN"))).otherwise("UNKNOWN")))


def is_mutation(command: Column) -> Column:
    """A write, or a git command that makes commits."""
    tidy = F.trim(command)
    opens = F.coalesce(F.when(~tidy.rlike(r"^git\b"), _second_command(tidy)), tidy)
    return F.when(family(command) == "WRITE_OR_EDIT", True).when(family(command) == "GIT", opens.rlike(GIT_WRITES)).otherwise(False)


def target_path(command: Column) -> Column:
    """The file a command names: a path option, a quoted name with an extension, or the last argument of a
    read; with backslashes."""
    found = lambda pattern: F.nullif(F.regexp_extract(command, pattern, 1), F.lit(""))
    words = F.split(F.trim(command), r"\s+")
    named = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: ~w.startswith("-") & w.contains("."))
    last = F.when(F.get(words, F.lit(0)).isin("cat", "head", "tail", "type"), F.try_element_at(named, F.lit(-1)))
    path = F.coalesce(found(r"(?i)-(?:LiteralPath|Path)\s+['\"]([^'\"]+)['\"]"), found(r"['\"]([^'\"*?<>|]+\.[a-zA-Z0-9_-]+)['\"]"), last)
    return F.replace(path, F.lit("/"), F.lit("\\"))


def line_range(command: Column) -> Column:
    """First and last line that a command shows, where it says so."""
    number = lambda pattern, k: F.regexp_extract(command, pattern, k).cast("long")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    zero = F.lit(0).cast("long")
    part, skip, first, head = r"\[(\d+)\.\.(\d+)\]", r"(?i)Select-Object\s+.*-Skip\s+(\d+)\s+.*-First\s+(\d+)", r"(?i)Select-Object\s+.*-First\s+(\d+)", r"\bhead\s+-n\s+(\d+)"
    return (
        F.when(command.rlike(part), pair(number(part, 1), number(part, 2)))
        .when(command.rlike(skip), pair(number(skip, 1), number(skip, 1) + number(skip, 2)))
        .when(command.rlike(first), pair(zero, number(first, 1)))
        .when(command.rlike(head), pair(zero, number(head, 1)))
    )


#: A name as commands give it: quoted by either mark, or bare up to the end.
NAME = r"(?:'([^'|;]+)'|\"([^\"|;]+)\"|([^'\"|;<>&]+?))"
# How reads and their bounds are spelled; shell reads by kind, first place unless given, and (first, last, name).
GET_CONTENT, SELECT = r"(?is)^Get-Content\b(.*)$", r"(?is)^Select-Object\b(.*)$"
PREFERENCE, SLICE = "$ErrorActionPreference", rf"(?is)^\(?Get-Content\s+{NAME}\)?\s*\[(\d+)\.\.(\d+)\]\s*$"
SHELL_READS = (
    ("FULL_FILE", None, rf"(?i)^(?:cat|type)\s+()(){NAME}\s*$"),
    ("LINE_RANGE", 1, rf"^head\s+(?:-n\s*|-)()(\d+)\s+{NAME}\s*$"),
    ("TAIL", None, rf"^tail\s+(?:-n\s*|-)(\d+)()\s+{NAME}\s*$"),
    ("BYTE_RANGE", 0, rf"^head\s+-c\s*()(\d+)\s+{NAME}\s*$"),
    ("LINE_RANGE", None, rf"^sed\s+-n\s+['\"]?(\d+),(\d+)p['\"]?\s+{NAME}\s*$"),
)
OPTION_PATH, NAMED_FILE = rf"(?i)-(?:LiteralPath|Path)\s+(?:'([^']+)'|\"([^\"]+)\"|([^\s'\"]+))", r"['\"]([^'\"*?<>|]+\.[a-zA-Z0-9_-]+)['\"]"
QUOTED = r"['\"]([^'\"]+)['\"]"
WITH_VALUE = r"(?i)-(?:Tail|Last|TotalCount|Head|First|Encoding|ReadCount|Delimiter)\s+\S+|-[A-Za-z]+"


def _name(text: Column, pattern: str, first: int = 1) -> Column:
    """What a name's three groups hold, from group ``first`` on; null if the pattern is not there or the name is blank."""
    found = F.trim(F.concat(*(F.regexp_extract(text, pattern, first + k) for k in range(3))))
    return F.when(text.rlike(pattern) & (found != ""), found)


def _option(text: Column, names: str) -> Column:
    return F.regexp_extract(text, rf"(?i)-(?:{names})\s+(\d+)(?!\S)", 1).try_cast("long")


def _view(path: Column, kind, start, stop, pure: bool) -> Column:
    none = F.lit(None).cast("long")
    of = lambda c: none if c is None else c.cast("long")
    return F.struct(path.alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("view"), of(start).alias("start"), of(stop).alias("stop"), F.lit(pure).alias("pure"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _get_content(command: Column) -> Column:
    """View of a Get-Content command; null if it is none. A stage behind it may only select objects, one further is too many."""
    return F.when(command.rlike(GET_CONTENT), _once(F.transform(F.split(F.regexp_extract(command, GET_CONTENT, 1), r"\|"), lambda s: F.trim(s)), lambda stages: _stages(command, stages)))


def _stages(command: Column, stages: Column) -> Column:
    """View of a Get-Content command whose arguments are split at pipes."""
    read, behind = F.get(stages, F.lit(0)), F.get(stages, F.lit(1))
    bare = F.nullif(F.regexp_extract(F.regexp_replace(read, WITH_VALUE, " "), r"^\s*(\S+)", 1), F.lit(""))
    path = F.coalesce(_name(read, OPTION_PATH), F.nullif(F.regexp_extract(read, QUOTED, 1), F.lit("")), bare)
    has = lambda text, names: F.coalesce(text.rlike(rf"(?i)-(?:{names})\b"), F.lit(False))
    of_end, of_start, first, last, skip = has(read, "Tail|Last"), has(read, "TotalCount|Head|First"), has(behind, "First"), has(behind, "Last"), has(behind, "Skip")
    quiet, start = ~command.rlike("[<>&]"), F.when(skip, _option(behind, "Skip") + 1).otherwise(1)
    whole, selects = quiet & behind.isNull(), quiet & (F.size(stages) == 2) & behind.rlike(SELECT) & ~of_end & ~of_start
    return (
        F.when(whole & of_end, _view(path, "TAIL", _option(read, "Tail|Last"), None, True))
        .when(whole & of_start, _view(path, "LINE_RANGE", F.lit(1), _option(read, "TotalCount|Head|First"), True))
        .when(whole, _view(path, "FULL_FILE", None, None, True))
        .when(selects & first & ~last, _view(path, "LINE_RANGE", start, start + _option(behind, "First") - 1, True))
        .when(selects & last & ~first & ~skip, _view(path, "TAIL", _option(behind, "Last"), None, True))
        .otherwise(_view(path, "OTHER", None, None, False))
    )


def read_view(command: Column) -> Column:
    """What a command reads: path, kind of view, bounds, and ``pure``, whether it does nothing but show that view.

    TAIL counts lines from the end as ``start``. A setting of the error preference may go before; several statements are an OTHER
    view and what is no read an UNKNOWN one, neither pure, with the file they name if there is one. Redirections, pipes into
    anything but a selection of lines, and chained commands are never pure. Null for null.
    """
    statements = F.filter(F.transform(F.split(command, ";"), lambda s: F.trim(s)), lambda s: s != "")
    prefixed = lambda s: (F.size(s) == 2) & F.get(s, F.lit(0)).startswith(PREFERENCE)
    parts = _once(statements, lambda s: F.struct(F.when(prefixed(s), F.get(s, F.lit(1))).otherwise(F.trim(command)).alias("text"), ((F.size(s) > 1) & ~prefixed(s)).alias("several")))
    seen = _once(parts, lambda p: _seen(p["text"], p["several"]))
    return F.when(command.isNotNull(), _once(seen, _whole))


def _seen(c: Column, several: Column) -> Column:
    file = F.nullif(F.regexp_extract(c, NAMED_FILE, 1), F.lit(""))
    number = lambda pattern, k: F.regexp_extract(c, pattern, k).try_cast("long")
    out = F.when(several, _view(F.coalesce(_name(c, OPTION_PATH), file), "OTHER", None, None, False))
    out = out.when(c.rlike(GET_CONTENT), _get_content(c)).when(c.rlike(SLICE), _view(_name(c, SLICE), "LINE_RANGE", number(SLICE, 4) + 1, number(SLICE, 5) + 1, True))
    for kind, start, pattern in SHELL_READS:
        out = out.when(c.rlike(pattern), _view(_name(c, pattern, 3), kind, number(pattern, 1) if start is None else F.lit(start), number(pattern, 2), True))
    return out.otherwise(_view(file, "UNKNOWN", None, None, False))


def _whole(seen: Column) -> Column:
    """A bound that no number holds, or no name, leaves nothing that a view could stand for."""
    bounded = F.when(seen["view"] == "TAIL", seen["start"].isNotNull()).when(seen["view"].isin("LINE_RANGE", "BYTE_RANGE"), seen["start"].isNotNull() & seen["stop"].isNotNull()).otherwise(True)
    return F.when(seen["pure"] & ~(bounded & seen["path"].isNotNull()), _view(seen["path"], "OTHER", None, None, False)).otherwise(seen)


def source_identity(path: Column) -> Column:
    """One name for a path: no quotes around it, forward slashes, no leading ``./``, no repeated slashes; in lower case behind a
    drive letter, where names differ in nothing by case. Patterns and shell marks have none."""
    bare = F.regexp_replace(F.trim(path), "^['\"`]+|['\"`]+$", "")
    tidy = F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("/")), r"/(?:\./)*/*", "/"), r"^\./", "")
    return F.when(~bare.rlike(r"[*?<>|\[\]]") & (bare != ""), F.when(tidy.rlike("^[A-Za-z]:"), F.lower(tidy)).otherwise(tidy))
