"""Queries over commands, envelopes, views and corpora harvested from logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import codecs, commands, envelopes, text, views
from tracewell.operators import corpus, harvest, pairing
from tracewell.sources.tables import TOOL_CALLS_SQL, table, tool_calls

# Commands that events are given in turn.
COMMANDS = (
    "cat src/a.py", "sed -n '1,20p' src/a.py", "head -n 5 ./b.py", "tail -20 c.py", "head -c 100 d.bin", "rg -n x src", "ls -la", "git status", "python -m pytest -q", "cat a.py > b.py", "apply_patch x",
    "make all", "curl http://x", "git grep foo", "git log --oneline", "git commit -m x", "python run.py", "Set-Content a", "rm x", "Get-Content -Path 'src/m.py' | Select-Object -Skip 10 -First 5", "GET-CHILDITEM src",
    "$r = 1; git status", "$r = 1; rg foo src", "$r = 1; git merge x", "node x.js", "echo hi", "pytest > out.txt", "findstr /n x y", "$x[10..50]; get-content 'z.txt'", "tree", "", "  ", "cargo build", "./run.sh", "cargo test 2>&1",
)


def _commands(spark, sf_dir):
    """Every event with a command: its own or the same behind a pipe, a redirection or an assignment."""
    i, n = F.col("event_id"), len(COMMANDS)
    base = F.get(F.array(*map(F.lit, COMMANDS)), (i % n).cast("int"))
    turn = F.floor(i / n) % 5
    command = F.when(turn == 1, F.concat(base, F.lit(" | head -n 7"))).when(turn == 2, F.concat(base, F.lit(" > out.txt"))).when(turn == 3, F.concat(F.lit("$a = 2; "), base)).when((turn == 4) & (i % 2 == 0), None).otherwise(base)
    return table(spark, sf_dir, "events").select("event_id", command.alias("command"))


def command_families(spark, sf_dir):
    c = F.col("command")
    r = commands.line_range(c)
    return _commands(spark, sf_dir).select("event_id", commands.family(c).alias("family"), commands.is_mutation(c).alias("writes"), commands.target_path(c).alias("target"), r["start"].alias("start"), r["stop"].alias("stop"))


def read_views(spark, sf_dir):
    """Reads among the commands, with one name for what they show."""
    v = _commands(spark, sf_dir).withColumn("view", commands.read_view(F.col("command"))).where(F.col("view.pure"))
    return v.select("event_id", commands.source_identity(F.col("view.path")).alias("path"), views.view_id(F.col("view.view"), F.col("view.start"), F.col("view.stop"), F.col("command")).alias("view_id"))


# Forms in which events read their file and, with the name of what they show and whether they do nothing else.
FORMS = (
    ("Get-Content '{p}'", "FULL_FILE", True), ("get-content -LiteralPath \"{p}\" -Tail {n}", "TAIL:{n}", True), ("Get-Content {p} -TotalCount {n}", "LINES:1-{n}", True), ("Get-Content -Head {n} {p}", "LINES:1-{n}", True),
    ("Get-Content -Path {p} | Select-Object -First {n} -Skip 3", "LINES:4-{m}", True), ("Get-Content '{p}' | select-object -Last {n}", "TAIL:{n}", True), ("$ErrorActionPreference='Stop'; Get-Content '{p}'", "FULL_FILE", True),
    ("(Get-Content '{p}')[0..{n}]", "LINES:1-{k}", True), ("cat '{p}'", "FULL_FILE", True), ("TYPE {p}", "FULL_FILE", True), ("head -n {n} \"{p}\"", "LINES:1-{n}", True), ("tail -n {n} {p}", "TAIL:{n}", True),
    ("Get-Content '{p}' | Select-String x", "OTHER", False), ("Get-Content '{p}' | Select-Object -First {n} | Set-Content b", "OTHER", False), ("cd src; Get-Content '{p}'", "OTHER", False), ("cat '{p}' > b.txt", "UNKNOWN", False), ("cat '{p}' && rm b", "UNKNOWN", False), ("sort '{p}'", "UNKNOWN", False),
)


def read_grammar(spark, sf_dir):
    """Every event as a read in one of many forms: the file by its one name, what is shown of it, and whether nothing else is done."""
    i = F.col("event_id")
    path, n = F.concat(F.when(i % 2 == 0, "C:\\Src\\my file ").otherwise("./src//file"), (i % 100).cast("string"), F.lit(".py")), (i % 40 + 1).cast("string")
    spaced = F.replace(path, F.lit("my file "), F.lit("file"))
    form = F.get(F.array(*(F.lit(f[0]) for f in FORMS)), (F.floor(i / 2) % len(FORMS)).cast("int"))
    quoted = form.rlike("['\"]\\{p")
    command = F.replace(F.replace(form, F.lit("{p}"), F.when(quoted, path).otherwise(spaced)), F.lit("{n}"), n)
    e = table(spark, sf_dir, "events").select("event_id", command.alias("command")).withColumn("view", commands.read_view(F.col("command")))
    name = views.view_id(F.col("view.view"), F.col("view.start"), F.col("view.stop"), F.col("command"))
    return e.select("event_id", commands.source_identity(F.col("view.path")).alias("path"), name.alias("view_id"), F.col("view.pure").alias("pure"))


def view_slices(spark, sf_dir):
    """Digest of what a line, tail, byte or whole view of every document shows, and what a recorded digest proves."""
    i = F.col("doc_id")
    view = F.get(F.array(*map(F.lit, ("FULL_FILE", "LINE_RANGE", "TAIL", "BYTE_RANGE", "OTHER"))), (i % 5).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ascii head\n"), "text").alias("text"), view.alias("view"), F.when(i % 3 > 0, i % 4).cast("long").alias("start"), F.when(i % 7 > 0, i % 11).cast("long").alias("stop"))
    d = d.withColumn("start", F.when(F.col("view") == "TAIL", F.coalesce("start", F.lit(2).cast("long"))).otherwise(F.col("start")))
    shown = views.view_text(F.col("text"), F.col("view"), F.col("start"), F.col("stop"))
    d = d.withColumn("sha", F.sha2(shown, 256)).withColumn("n_bytes", F.octet_length(shown).cast("long"))
    held = F.when(i % 6 == 0, None).when(i % 6 == 1, "stale").otherwise(F.col("sha"))
    return d.select("doc_id", "view", "n_bytes", "sha", views.live_proof(held, F.col("sha")).alias("proof"))


def _enveloped(spark, sf_dir):
    """Calls and results in the forms that tools give them."""
    i = F.col("event_id")
    command = F.concat(F.lit("rg -n x"), i.cast("string"), F.lit(" src"))
    kind = F.when(i % 13 == 0, "function_call").otherwise("custom_tool_call")
    given = (
        F.when(i % 6 == 0, F.to_json(F.struct(command.alias("cmd"))))
        .when(i % 6 == 1, F.concat(F.lit('const r = await tools.exec_command({ cmd: "'), command, F.lit('", timeout: 10, env: { a: "b,c" } });')))
        .when(i % 6 == 2, F.concat(F.lit("tools.exec_command({'cmd': '"), command, F.lit("'})")))
        .when(i % 6 == 3, F.concat(F.lit('tools.exec_command({cmd: "a"}); tools.exec_command({cmd: "'), command, F.lit('"})')))
        .when(i % 6 == 4, F.lit('tools.exec_command({cmd: "a", cmd: "b"})'))
        .otherwise(F.lit('tools.exec_command({cmd: variable})'))
    )
    body = F.concat(F.lit("src/a.py:1:x\n"), F.when(i % 4 == 0, "output truncated\n").otherwise("src/a.py:2:y\n"))
    output = (
        F.when(i % 7 == 0, F.to_json(F.struct((i % 3).alias("exit_code"), body.alias("output"))))
        .when(i % 7 == 1, F.to_json(F.struct((i % 3).alias("exit_code"), body.alias("output"), F.lit(True).alias("truncated"))))
        .when(i % 7 == 2, F.to_json(F.array(F.struct(F.lit("Script completed in 1s").alias("text")), F.struct(body.alias("text")))))
        .when(i % 7 == 3, F.to_json(F.array(F.struct(F.lit("Script failed with exit code 3").alias("text")), F.struct(body.alias("text")))))
        .when(i % 7 == 4, F.to_json(F.array(F.struct(F.to_json(F.struct(F.lit(0).alias("exit_code"), body.alias("output"))).alias("text")))))
        .when(i % 7 == 5, F.lit('{"exit_code": true, "output": "x"}'))
        .otherwise(F.concat(F.lit("plain "), body))
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("type"), F.when(i % 11 == 0, "apply").otherwise("exec").alias("name"), given.alias("input"), output.alias("raw"))


def _decoded(spark, sf_dir):
    e = _enveloped(spark, sf_dir)
    return e.withColumn("command", envelopes.exec_command_udf()("type", "name", "input")).withColumn("r", envelopes.tool_output_udf()("raw")).select("event_id", "user_id", "command", "r.*")


def envelope_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("event_id", "command", F.sha2("output", 256).alias("sha"), F.col("exit_code").cast("long").alias("exit_code"), "truncated", "structured")


def clean_search_exclusions(spark, sf_dir):
    """Why outputs are not clean search outputs, and how many are."""
    d = _decoded(spark, sf_dir).withColumn("call_id", F.when(F.col("event_id") % 37 > 0, F.col("event_id"))).withColumn("sensitive", text.contains_sensitive(F.col("output")))
    g = codecs.grouping_udf()(F.col("output").cast("binary"), F.col("command"), F.col("exit_code"), F.col("truncated"), F.lit("combined"))
    d = d.withColumn("why", harvest.clean_search_reason(d, g["reason"]))
    return d.groupBy(F.coalesce("why", F.lit("CLEAN")).alias("reason")).agg(F.count("*").alias("calls"), F.min("event_id").alias("first"))


def _harvested(spark, sf_dir):
    c = _commands(spark, sf_dir).where(F.col("command").isNotNull())
    i = F.col("event_id")
    output = F.when(i % 9 == 0, "3 failed, 2 passed\n").when(i % 9 == 1, "0 failed, 5 passed\n").when(i % 9 == 2, "Downloading 5%\n").when(i % 9 == 3, "x\nFAILED tests\n").otherwise("fine\n")
    code = F.when(i % 8 == 0, 1).when(i % 8 < 6, 0)
    return c.withColumn("output", output).withColumn("exit_code", code).withColumn("stratum", harvest.stratum(F.col("command"), F.col("output"), F.col("exit_code")))


def harvest_labels(spark, sf_dir):
    s = harvest.suggested_label(F.col("stratum"), F.col("exit_code"))
    return _harvested(spark, sf_dir).select("event_id", "stratum", s["evidence"].alias("evidence"), s["eligibility"].alias("eligibility"), s["bucket"].alias("bucket"))


def harvest_sample(spark, sf_dir):
    return harvest.stratified(_harvested(spark, sf_dir).select("event_id", "stratum"), "stratum", "event_id", harvest.TARGETS).select("event_id", "stratum")


def match_line_stats(spark, sf_dir):
    c = tool_calls(table(spark, sf_dir, "events")).where(F.col("tool_family") == "SEARCH")
    line = F.transform(F.sequence(F.lit(1), (1 + F.col("k") % 9).cast("int")), lambda i: F.concat(F.lit("src/m"), (i % 3).cast("string"), F.lit(".py:"), (i % 4).cast("string"), F.lit(":text\n")))
    return harvest.characterise(c.withColumn("out", F.array_join(line, "")), "event_id", F.col("out"))


def bounded_pairing(spark, sf_dir):
    """Calls and outputs of twenty ids in turn, paired while at most four calls of a session wait."""
    i, e = F.col("call_index"), tool_calls(table(spark, sf_dir, "events"))
    records = e.select("session_id", i.alias("record_index"), (F.col("k") % 2 == 0).alias("is_call"), (F.floor(i / 40) * 20 + F.col("event_id") % 20).alias("call_id"))
    return pairing.bounded_pairs(records, 4)


def latency_percentiles(spark, sf_dir):
    """Interpolated percentiles of values by type; one value is its own percentile."""
    e = table(spark, sf_dir, "events")
    at = lambda p: F.round(F.percentile("value", p / 100), 6).alias(f"p{p}")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *[at(p) for p in (50, 95, 99, 100)])


def reads_around_edits(spark, sf_dir):
    """Reads before and after an episode's first write; episodes without one count as before."""
    c = tool_calls(table(spark, sf_dir, "events"))
    first = F.min(F.when(F.col("is_mutation"), F.col("call_index"))).over(W.partitionBy("session_id", "episode_id"))
    r = c.withColumn("first", first).where(F.col("tool_family") == "FILE_READ")
    before = F.col("first").isNull() | (F.col("call_index") < F.col("first"))
    return r.groupBy("session_id").agg(F.count_if(before).alias("before"), F.count_if(~before).alias("after"))


def quality_strata(spark, sf_dir):
    """Evenly spaced documents of every language, numbered through ranges of ids."""
    return corpus.periodic_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 12)


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_COMMAND_LIST = "[" + ", ".join(map(_lit, COMMANDS)) + "]"
_CMD = f"""cm AS (SELECT event_id, {_COMMAND_LIST}[event_id % {len(COMMANDS)} + 1] AS base, event_id // {len(COMMANDS)} % 5 AS turn FROM events),
  c0 AS (SELECT event_id, CASE WHEN turn = 1 THEN base || ' | head -n 7' WHEN turn = 2 THEN base || ' > out.txt' WHEN turn = 3 THEN '$a = 2; ' || base WHEN turn = 4 AND event_id % 2 = 0 THEN NULL ELSE base END AS command FROM cm),
  c1 AS (SELECT *, trim(command) AS t, CASE WHEN lower(regexp_extract(trim(command), ';\\s*([\\w.-]+)', 1)) IN ('git', 'pytest', 'rg', 'get-content', 'get-childitem') THEN trim(regexp_extract(trim(command), '(?s);(\\s*[\\w.-]+.*)', 1)) END AS sub FROM c0)"""


def _family_sql(c: str, rest: str) -> str:
    writes = f"contains({c}, 'WriteAllText') OR regexp_matches({c}, '(?i)\\b(Set-Content|Out-File|apply_patch|git apply|patch)\\b') OR contains({c}, 'patch ')"
    return f"""CASE WHEN {writes} OR (regexp_matches({c}, '(^|\\D)>[^>]') AND NOT regexp_matches({c}, '\\bpytest\\b')) THEN 'WRITE_OR_EDIT'
      WHEN regexp_matches({c}, '\\b(pytest|python -m unittest|npm test|ctest|cargo test)\\b') THEN 'TEST' WHEN regexp_matches({c}, '\\b(make|cargo build|npm run build|python -m compileall)\\b') THEN 'BUILD'
      WHEN regexp_matches({c}, '^(grep|rg|findstr|git grep)\\b') THEN 'SEARCH' WHEN regexp_matches({c}, '(?i)\\b(cat|head|tail|type|more|less|get-content)\\b') THEN 'FILE_READ' WHEN regexp_matches({c}, '(?i)\\b(ls|dir|tree|get-childitem)\\b') THEN 'DIRECTORY_LIST'
      WHEN regexp_matches({c}, '^git\\b') THEN 'GIT' WHEN regexp_matches({c}, '^(python|node|bash|sh|pwsh|powershell|wsl\\.exe|\\./)\\b') THEN 'SCRIPT'
      WHEN regexp_matches({c}, '(?i)^(cd|pwd|echo|which|where|sleep|start-sleep|gcloud|get-process|get-ciminstance)\\b') THEN 'OTHER' ELSE {rest} END"""


_forms = ", ".join("({}, {}, '{}', {})".format(k, "'" + f.replace("'", "''") + "'", name, pure) for k, (f, name, pure) in enumerate(FORMS))
_ENV = """en AS (
  SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 OR event_id % 11 = 0 OR event_id % 6 > 2 THEN NULL ELSE 'rg -n x' || event_id || ' src' END AS command,
    'src/a.py:1:x' || chr(10) || CASE WHEN event_id % 4 = 0 THEN 'output truncated' ELSE 'src/a.py:2:y' END || chr(10) AS body, event_id % 7 AS form FROM events
), de AS (
  SELECT *, form < 5 AS structured, CASE WHEN form = 5 THEN '{"exit_code": true, "output": "x"}' WHEN form = 6 THEN 'plain ' || body ELSE body END AS output,
    CAST(CASE WHEN form < 2 THEN event_id % 3 WHEN form = 2 THEN 0 WHEN form = 3 THEN 3 WHEN form = 4 THEN 0 END AS BIGINT) AS exit_code,
    CASE WHEN form = 1 THEN true WHEN form IN (2, 3, 6) THEN event_id % 4 = 0 ELSE false END AS truncated FROM en
)"""
_HARVEST = f"""{_CMD}, h0 AS (SELECT event_id, command, lower(command) AS l, event_id % 9 AS o, CASE WHEN event_id % 8 = 0 THEN 1 WHEN event_id % 8 < 6 THEN 0 END AS exit_code FROM c0 WHERE command IS NOT NULL),
  h AS (SELECT *, CASE WHEN regexp_matches(l, 'pytest|python -m unittest|cargo test|npm test') THEN CASE WHEN exit_code = 1 OR o IN (0, 3) THEN 'test_failure' ELSE 'test_success' END
    WHEN regexp_matches(l, 'git |git\\.exe') THEN 'git' WHEN regexp_matches(l, 'rg --files|dir |get-childitem|ls |find ') THEN 'dir_list' WHEN regexp_matches(l, 'rg |grep ') THEN 'search'
    WHEN regexp_matches(l, 'get-content|cat |read_file|type ') THEN 'file_read' WHEN o = 2 THEN 'progress_build' ELSE 'script_or_unknown' END AS stratum FROM h0)"""
_targets = ", ".join(f"('{k}', {v})" for k, v in harvest.TARGETS.items())
_big = "CAST({} AS BIGINT)".format

SQL = {
    "command_families": f"""WITH {_CMD}, f AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'UNKNOWN' ELSE {_family_sql('t', 'CASE WHEN sub IS NULL THEN ' + _lit('UNKNOWN') + ' ELSE ' + _family_sql('sub', _lit('UNKNOWN')) + ' END')} END AS family FROM c1),
      p AS (SELECT *, string_split_regex(t, '\\s+') AS w FROM f)
      SELECT event_id, family, family = 'WRITE_OR_EDIT' OR (family = 'GIT' AND regexp_matches(coalesce(CASE WHEN t LIKE 'git%' THEN t ELSE sub END, t), '\\b(commit|merge|rebase|revert|cherry-pick)\\b')) AS writes,
        replace(coalesce(nullif(regexp_extract(command, '(?i)-(Literal)?Path\\s+[''"]([^''"]+)', 2), ''), nullif(regexp_extract(command, '[''"]([^''"*?<>|]+\\.[\\w-]+)[''"]', 1), ''),
          CASE WHEN w[1] IN ('cat', 'head', 'tail', 'type') THEN list_filter(w[2:], lambda x: x NOT LIKE '-%' AND contains(x, '.'))[-1] END), '/', '\\') AS target,
        CASE WHEN regexp_matches(command, '\\[\\d+\\.\\.\\d+\\]') THEN {_big("regexp_extract(command, '\\[(\\d+)', 1)")} WHEN contains(command, '-Skip') THEN 10 WHEN regexp_matches(command, 'head -n \\d') THEN 0 END AS start,
        CASE WHEN regexp_matches(command, '\\[\\d+\\.\\.\\d+\\]') THEN {_big("regexp_extract(command, '\\.\\.(\\d+)', 1)")} WHEN contains(command, '-Skip') THEN 15 WHEN regexp_matches(command, 'head -n \\d') THEN {_big("regexp_extract(command, 'head -n (\\d+)', 1)")} END AS stop FROM p""",
    "read_views": f"""WITH {_CMD} SELECT event_id, CASE WHEN command LIKE 'Get%' THEN 'src/m.py' WHEN command LIKE 'head -c%' THEN 'd.bin' WHEN command LIKE 'head%' THEN 'b.py' WHEN command LIKE 'tail%' THEN 'c.py' ELSE 'src/a.py' END AS path,
      CASE WHEN command LIKE 'Get%' THEN 'LINES:11-15' WHEN command LIKE 'sed%' THEN 'LINES:1-20' WHEN command LIKE 'head -c%' THEN 'BYTES:0-100' WHEN command LIKE 'head%' THEN 'LINES:1-5' WHEN command LIKE 'tail%' THEN 'TAIL:20' ELSE 'FULL_FILE' END AS view_id
      FROM c0 WHERE command IN ('cat src/a.py', 'sed -n ''1,20p'' src/a.py', 'head -n 5 ./b.py', 'tail -20 c.py', 'head -c 100 d.bin', 'Get-Content -Path ''src/m.py'' | Select-Object -Skip 10 -First 5')""",
    "read_grammar": f"""WITH g(place, form, name, pure) AS (VALUES {_forms}), e AS (SELECT event_id, form, name, pure, event_id % 40 + 1 AS n, regexp_matches(form, '[''"]\\{{p') AS quoted, CASE WHEN event_id % 2 = 0 THEN 'C:\\Src\\' || CASE WHEN quoted THEN 'my file ' ELSE 'file' END || (event_id % 100) ELSE './src//file' || (event_id % 100) END || '.py' AS p FROM events JOIN g ON place = event_id // 2 % {len(FORMS)}),
      c AS (SELECT *, replace(replace(form, '{{p}}', p), '{{n}}', '' || n) AS command FROM e)
      SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c:/src/' || CASE WHEN quoted THEN 'my file ' ELSE 'file' END || (event_id % 100) ELSE 'src/file' || (event_id % 100) END || '.py' AS path,
        CASE WHEN name IN ('OTHER', 'UNKNOWN') THEN name || ':' || left(sha256(command), 12) ELSE replace(replace(replace(name, '{{n}}', '' || n), '{{m}}', '' || (n + 3)), '{{k}}', '' || (n + 1)) END AS view_id, pure FROM c""",
    "view_slices": f"""WITH d AS (SELECT doc_id, 'ascii head' || chr(10) || text AS text, ['FULL_FILE', 'LINE_RANGE', 'TAIL', 'BYTE_RANGE', 'OTHER'][doc_id % 5 + 1] AS view, CASE WHEN doc_id % 3 > 0 THEN doc_id % 4 END AS a, CASE WHEN doc_id % 7 > 0 THEN doc_id % 11 END AS b FROM documents),
      l AS (SELECT *, regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+') AS ls FROM d),
      s AS (SELECT *, CASE view WHEN 'LINE_RANGE' THEN array_to_string(list_slice(ls, greatest(coalesce(a, 1), 1), least(coalesce(b, len(ls)), len(ls))), '') WHEN 'TAIL' THEN array_to_string(list_slice(ls, greatest(len(ls) - coalesce(a, 2), 0) + 1, len(ls)), '')
        WHEN 'BYTE_RANGE' THEN CASE WHEN b IS NULL THEN substr(text, coalesce(a, 0) + 1) ELSE substr(text, coalesce(a, 0) + 1, greatest(b - coalesce(a, 0), 0)) END ELSE text END AS shown FROM l)
      SELECT doc_id, view, strlen(shown) AS n_bytes, sha256(shown) AS sha, CASE doc_id % 6 WHEN 0 THEN 'UNPROVEN' WHEN 1 THEN 'SOURCE_CHANGED' ELSE 'VIEW_EQUAL' END AS proof FROM s""",
    "envelope_decode": f"WITH {_ENV} SELECT event_id, command, sha256(output) AS sha, exit_code, truncated, structured FROM de",
    "clean_search_exclusions": f"""WITH {_ENV}, y AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'NO_CALL_ID' WHEN exit_code IS NULL THEN 'ENVELOPE' WHEN command IS NULL THEN 'INVOCATION' WHEN exit_code = 1 THEN 'EXIT_1' WHEN exit_code >= 2 THEN 'EXIT_2_OR_MORE' WHEN truncated THEN 'TRUNCATED'
      WHEN event_id % 4 = 0 THEN 'TRUNCATION_SIGN' ELSE 'CLEAN' END AS reason FROM de) SELECT reason, count(*) AS calls, min(event_id) AS first FROM y GROUP BY 1""",
    "harvest_labels": f"""WITH {_HARVEST} SELECT event_id, stratum, CASE WHEN exit_code = 1 THEN 'FAILURE' WHEN stratum IN ('git', 'file_read') THEN 'CANONICAL_STATE' WHEN stratum = 'test_success' THEN 'SUCCESS_SUMMARY' WHEN stratum = 'test_failure' THEN 'FAILURE' WHEN stratum IN ('dir_list', 'search') THEN 'DISCOVERY' WHEN stratum = 'progress_build' THEN 'PROGRESS' ELSE 'UNKNOWN' END AS evidence,
      CASE WHEN exit_code IS DISTINCT FROM 1 AND stratum IN ('test_success', 'dir_list', 'progress_build', 'search') THEN 'SAFE_TO_REDUCE' ELSE 'RAW_REQUIRED' END AS eligibility,
      CASE WHEN exit_code = 1 THEN NULL ELSE map_extract_value(map {{'test_success': 'KNOWN_SUCCESS_RECORDS', 'dir_list': 'DIRECTORY_OR_PATH_REDUNDANCY', 'progress_build': 'REPETITIVE_PROGRESS', 'search': 'DUPLICATED_HEADERS'}}, stratum) END AS bucket FROM h""",
    "harvest_sample": f"""WITH {_HARVEST}, g(stratum, target) AS (VALUES {_targets}), p AS (SELECT event_id, h.stratum, target, count(*) OVER (PARTITION BY h.stratum) AS n, row_number() OVER (PARTITION BY h.stratum ORDER BY event_id) - 1 AS place FROM h JOIN g USING (stratum))
      SELECT event_id, stratum FROM p WHERE n <= target OR list_contains(list_transform(range(target), lambda i: i * n // target), place)""",
    "match_line_stats": f"""WITH {TOOL_CALLS_SQL}, x AS (SELECT event_id, list_transform(range(1, 2 + k % 9), lambda i: 'src/m' || i % 3 || '.py') AS p, list_transform(range(1, 2 + k % 9), lambda i: i % 3 || ':' || i % 4) AS l FROM tool_calls WHERE tool_family = 'SEARCH')
      SELECT event_id, len(l) AS records, len(list_distinct(p)) AS paths, len(l) - len(list_distinct(p)) AS repeated_paths, len(l) - len(list_distinct(l)) AS repeated_records FROM x""",
    "bounded_pairing": f"""WITH {TOOL_CALLS_SQL}, r AS (SELECT session_id, call_index AS i, k % 2 = 0 AS is_call, call_index // 40 * 20 + event_id % 20 AS call_id FROM tool_calls),
      e AS (SELECT *, lead(i) OVER w AS stop, lead(is_call) OVER w AS again FROM r WINDOW w AS (PARTITION BY session_id, call_id ORDER BY i)),
      c AS (SELECT session_id, call_id, i, stop, again FROM e WHERE is_call),
      t AS (SELECT a.session_id, a.i, b.i AS at, count(*) AS newer FROM c a JOIN c b ON b.session_id = a.session_id AND b.i > a.i AND b.i < coalesce(a.stop, 1e9) JOIN c x ON x.session_id = a.session_id AND x.i > a.i AND x.i <= b.i AND coalesce(x.stop, 1e9) > b.i GROUP BY 1, 2, 3),
      o AS (SELECT DISTINCT session_id, i FROM t WHERE newer >= 4)
      SELECT c.session_id, c.call_id, c.i AS call_index, CASE WHEN o.i IS NOT NULL THEN 'EVICTED' WHEN again THEN 'REPLACED' WHEN stop IS NULL THEN 'WAITING' ELSE 'PAIRED' END AS state, CASE WHEN o.i IS NULL AND NOT again THEN stop END AS output_index
      FROM c LEFT JOIN o ON o.session_id = c.session_id AND o.i = c.i""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 95, 99, 100)) + " FROM events GROUP BY 1",
    "reads_around_edits": f"""WITH {TOOL_CALLS_SQL}, w AS (SELECT session_id, episode_id, min(call_index) AS first FROM tool_calls WHERE is_mutation GROUP BY 1, 2)
      SELECT session_id, count(*) FILTER (first IS NULL OR call_index < first) AS before, count(*) FILTER (call_index > first) AS after FROM tool_calls LEFT JOIN w USING (session_id, episode_id) WHERE tool_family = 'FILE_READ' GROUP BY 1""",
    "quality_strata": "WITH p AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents) SELECT doc_id, lang FROM p WHERE n <= 12 OR list_contains(list_transform(range(12), lambda i: i * n // 12), place)",
}
QUERIES = {name: globals()[name] for name in SQL}
