"""Mission context: when a foundation may be a reference instead of its bytes, candidates and their restoration. Delivery is always raw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import contains_sensitive, occurrences

REFERENCE = "[[CONTEXT sha256=%s bytes=%d]]"


def mode_decisions(rows: DataFrame, facts: Column) -> DataFrame:
    """Ordered reason and the bytes a candidate would avoid.

    ``rows`` has mode, foundation, repeated, delta, inline and assessment; ``facts`` must each
    stand in ``inline`` as often as in the foundation.
    """
    mode, delta, inline = F.col("mode"), F.col("delta"), F.col("inline")
    given = F.when((mode == "DROP_DUPLICATE") & F.col("repeated").isNotNull(), F.col("repeated")).otherwise(F.col("foundation"))
    raw = F.octet_length(given) + F.octet_length(delta)
    reference = F.format_string(REFERENCE, F.sha2("foundation", 256), F.octet_length("foundation"))
    candidate = F.octet_length(reference) + 1 + F.octet_length(inline) + F.octet_length(delta)
    held = F.forall(facts, lambda f: occurrences(inline, f) >= occurrences(F.col("foundation"), f))
    reason = (
        F.when(F.coalesce(F.col("assessment"), F.lit("UNKNOWN")) != "NON_SENSITIVE", "ASSESSMENT")
        .when(contains_sensitive(inline) | contains_sensitive(delta), "SENSITIVE")
        .when(mode == "INLINE_CRITICAL", "BASELINE")
        .when(mode.isin("REFERENCE_CANONICAL", "DROP_DUPLICATE") & (delta != ""), "EXACT_DUPLICATE_NEEDED")
        .when((mode == "DELTA") & (delta == ""), "DELTA_NEEDED")
        .when((mode == "DROP_DUPLICATE") & ~F.col("repeated").eqNullSafe(F.col("foundation")), "REPEAT_NOT_PROVEN")
        .when((mode != "DROP_DUPLICATE") & F.col("repeated").isNotNull(), "REPEAT_NOT_ALLOWED")
        .when(~held, "FACTS_NOT_INLINE")
        .when(candidate >= raw, "NOT_ECONOMIC")
        .otherwise("CANDIDATE")
    )
    return rows.withColumn("reason", reason).withColumn("avoided_bytes", F.when(F.col("reason") == "CANDIDATE", raw - candidate).otherwise(0).cast("long"))


# Classes of a mission's bytes, and of how sure its accounting is.
INLINE, REFERENCE_CLASS, DELTA, DUPLICATE = "INLINE_CRITICAL", "REFERENCE_CANONICAL", "DELTA", "DROP_DUPLICATE"
MARKER = '[[CANONICAL {"end":%d,"path":"%s","sha256":"%s","start":%d}]]'
SAFE_PATH = r"^(?!/)(?!.*(?:^|/)(?:\.{0,2})(?:/|$))[^\x00\r\n]+$"


def _cut(data: Column, start: Column, stop: Column) -> Column:
    """Bytes from ``start`` up to ``stop``; offsets from 0."""
    return F.substring(data, (start + 1).cast("int"), (stop - start).cast("int"))


def _ends(spans: Column) -> Column:
    """Where each span's predecessor ends; 0 for the first, and one entry more for what follows the last."""
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))


def _marker(s: Column) -> Column:
    return F.format_string(MARKER, s["to"], s["path"], s["sha"], s["from"])


def prove_spans(missions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Missions with ``n``, ``valid``, and their spans in order, each with ``proven`` and the bytes ``shown`` of it.

    What a row can show of itself (layout, repeats) is proven in the row. Of references only the place, the digest of the
    segment and the span's number travel to the artifacts, and only numbers come back. ``mission`` is a unique id.
    Without bytes, or with spans that overlap or leave them, a mission is not valid and has no spans.
    """
    kind = missions.schema["spans"].dataType
    by_place = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["stop"] < b["stop"])), -1).when((a["start"] == b["start"]) & (a["stop"] == b["stop"]), 0).otherwise(1)
    m = missions.withColumn("n", F.octet_length("raw").cast("long")).withColumn("spans", F.array_sort(F.coalesce("spans", F.array().cast(kind)), by_place))
    laid = F.forall(F.zip_with("spans", F.slice(_ends(F.col("spans")), 1, F.size("spans")), lambda s, e: (s["start"] >= e) & (s["stop"] > s["start"]) & (s["stop"] <= F.col("n"))), lambda ok: ok)
    m = m.withColumn("valid", F.coalesce(F.col("raw").isNotNull() & laid, F.lit(False))).withColumn("spans", F.when(F.col("valid"), F.col("spans")).otherwise(F.array().cast(kind)))
    claim = lambda s, k: F.struct(k.alias("nth"), s["kind"].alias("kind"), *(s[c].alias(c) for c in ("path", "sha", "from", "to")), F.when(s["kind"] == REFERENCE_CLASS, F.sha2(_cut(F.col("raw"), s["start"], s["stop"]), 256)).alias("piece"))
    claims = m.select("mission", F.inline(F.filter(F.transform("spans", claim), lambda c: (c["kind"] == REFERENCE_CLASS) & c["path"].rlike(SAFE_PATH) & (c["from"] >= 0) & (c["to"] > c["from"]))))
    a = artifacts.select(F.col("path"), F.col("sha"), F.col("content").alias("_content"))
    held = (F.col("to") <= F.octet_length("_content")) & (F.sha2("_content", 256) == F.col("sha")) & (F.sha2(_cut(F.col("_content"), F.col("from"), F.col("to")), 256) == F.col("piece"))
    found = claims.join(a, ["path", "sha"]).where(held).groupBy("mission").agg(F.collect_set("nth").alias("_found"))
    allowed = (F.coalesce(F.col("assessment"), F.lit("")) == "NON_SENSITIVE") & ~F.coalesce(contains_sensitive(F.col("raw").cast("string")), F.lit(False))
    # scanned once a mission: below the join, the scan cannot be drawn into the steps over spans
    m = m.withColumn("_allowed", allowed).join(found, "mission", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<int>")))
    m = m.withColumn("_gone", F.filter("spans", lambda s: s["kind"].isin(REFERENCE_CLASS, DUPLICATE)))

    def earlier(s):
        inside = (s["from"] >= 0) & (s["to"] > s["from"]) & (s["to"] <= s["start"]) & (s["to"] - s["from"] == s["stop"] - s["start"])
        clear = ~F.exists("_gone", lambda g: (s["from"] < g["stop"]) & (g["start"] < s["to"]))
        return F.coalesce(inside & clear & (_cut(F.col("raw"), s["from"], s["to"]) == _cut(F.col("raw"), s["start"], s["stop"])), F.lit(False))

    proven = lambda s, k: F.when(s["kind"].isin(INLINE, DELTA), True).when(~F.col("_allowed"), False).when(s["kind"] == REFERENCE_CLASS, F.array_contains("_found", k)).otherwise(earlier(s))
    size = lambda s: s["stop"] - s["start"]
    shown = lambda s: F.when(~s["proven"] | s["kind"].isin(INLINE, DELTA), size(s)).when(s["kind"] == DUPLICATE, 0).otherwise(F.least(size(s), F.octet_length(_marker(s)))).cast("long")
    m = m.withColumn("spans", F.transform("spans", lambda s, k: s.withField("proven", proven(s, k))))
    return m.withColumn("spans", F.transform("spans", lambda s: s.withField("shown", shown(s)))).drop("_found", "_allowed", "_gone")


def account_spans(missions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Bytes of every mission by class, and the size of the candidate that its proven spans allow.

    ``missions``: mission, raw (binary), assessment, and spans as structs of start, stop, kind, path, sha,
    from, to. ``artifacts``: path, sha, content (binary). A reference span is proven if the artifact of
    that path and digest holds the same bytes from ``from`` to ``to``; a duplicate if its source of the
    same length ends before it, touches no span that may go, and equals it. What is not proven stays and
    counts as unknown, as do gaps; classes add up to the mission. Spans that overlap or leave the text
    make the whole mission unknown.
    """
    m = prove_spans(missions, artifacts)
    total = lambda of: F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + of(s).cast("long"))
    of = lambda k, name: total(lambda s: F.when(s["proven"] & (s["kind"] == k), s["stop"] - s["start"]).otherwise(0)).alias(name)
    known = F.col("inline_bytes") + F.col("delta_bytes") + F.col("reference_bytes") + F.col("duplicate_bytes")
    out = m.select(
        "mission", F.col("n").alias("raw_bytes"), "valid", of(INLINE, "inline_bytes"), of(DELTA, "delta_bytes"), of(REFERENCE_CLASS, "reference_bytes"), of(DUPLICATE, "duplicate_bytes"),
        total(lambda s: F.when(s["proven"], 0).otherwise(1)).alias("failures"), total(lambda s: s["stop"] - s["start"] - s["shown"]).alias("_saved"),
    )
    return out.withColumn("unknown_bytes", F.col("raw_bytes") - known).withColumn("candidate_bytes", F.col("raw_bytes") - F.col("_saved")).drop("_saved")


def assemble(missions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per mission the ``candidate`` bytes and the ``recipe`` that restores the mission from them.

    Everything that :func:`account_spans` counts as saved is left out: a proven reference shows its marker where that is
    shorter, a proven duplicate nothing. The recipe lists those spans alone, in order. The mission itself is still what
    is delivered; ``raw_sha`` and ``n`` say what a restoration has to give. A mission that is not valid is its own candidate.
    """
    m = prove_spans(missions, artifacts)
    part = lambda a, b: F.hex(_cut(F.col("raw"), a, b))
    left_out = lambda s: s["shown"] < s["stop"] - s["start"]
    text = lambda s: F.when(~left_out(s), part(s["start"], s["stop"])).when(s["kind"] == DUPLICATE, "").otherwise(F.hex(_marker(s).cast("binary")))
    ends = _ends(F.col("spans"))
    shown = F.array_join(F.transform("spans", lambda s, k: F.concat(part(F.get(ends, k), s["start"]), text(s))), "")
    candidate = F.unhex(F.concat(shown, part(F.get(ends, F.size("spans")), F.col("n"))))
    recipe = F.transform(F.filter("spans", left_out), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "stop", "kind", "path", "sha", "from", "to", "shown"))))
    return m.select("mission", "valid", "n", F.sha2("raw", 256).alias("raw_sha"), candidate.alias("candidate"), recipe.alias("recipe"))


def restore(candidates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per candidate of :func:`assemble` its ``outcome``, and the mission's bytes as ``restored`` if every check holds.

    References are fetched by an equal join on path and digest; repeats are copied from the candidate, as their sources
    lie in what was kept. A marker must stand where the recipe says, an artifact must match its digest, and the whole
    must match the mission's length and digest; the first of these that fails is the outcome.
    """
    c = candidates.select("mission", "n", "raw_sha", "candidate", "recipe")
    asked = c.select("mission", F.inline(F.filter(F.transform("recipe", lambda g, k: F.struct(k.alias("nth"), *(g[f].alias(f) for f in ("kind", "path", "sha", "from", "to")))), lambda g: g["kind"] == REFERENCE_CLASS)))
    a = artifacts.select("path", "sha", F.col("content").alias("_content"))
    piece = F.hex(_cut(F.col("_content"), F.col("from"), F.col("to")))
    fetched = asked.join(a, ["path", "sha"]).where(F.sha2("_content", 256) == F.col("sha")).groupBy("mission").agg(F.map_from_entries(F.collect_set(F.struct("nth", piece.alias("piece")))).alias("_pieces"))
    c = c.join(fetched, "mission", "left")
    # how far the candidate runs ahead of the mission (at most 0) at a place of the mission
    shift = lambda place: F.aggregate(F.filter("recipe", lambda g: g["stop"] <= place), F.lit(0).cast("long"), lambda acc, g: acc + g["shown"] - (g["stop"] - g["start"]))
    kept = lambda a, b: F.hex(_cut(F.col("candidate"), a + shift(a), b + shift(a)))
    ends = _ends(F.col("recipe"))
    spot = lambda g: g["start"] + shift(g["start"])
    marked = F.forall("recipe", lambda g: (g["kind"] == DUPLICATE) | (_cut(F.col("candidate"), spot(g), spot(g) + g["shown"]) == _marker(g).cast("binary")))
    found = F.forall(F.transform("recipe", lambda g, k: (g["kind"] == DUPLICATE) | F.coalesce(F.map_contains_key("_pieces", k), F.lit(False))), lambda ok: ok)
    whole = F.transform("recipe", lambda g, k: F.concat(kept(F.get(ends, k), g["start"]), F.when(g["kind"] == DUPLICATE, kept(g["from"], g["to"])).otherwise(F.try_element_at("_pieces", k))))
    last = F.get(ends, F.size("recipe"))
    c = c.withColumn("_whole", F.unhex(F.concat(F.array_join(whole, ""), kept(last, F.col("n")))))
    outcome = (
        F.when(F.col("candidate").isNull(), "NO_CANDIDATE")
        .when(~F.coalesce(marked, F.lit(False)), "MARKER_MISMATCH")
        .when(~found, "MISSING_ARTIFACT")
        .when((F.octet_length("candidate") != F.col("n") + shift(F.col("n"))) | (F.octet_length("_whole") != F.col("n")), "LENGTH_MISMATCH")
        .when(F.sha2("_whole", 256) != F.col("raw_sha"), "DIGEST_MISMATCH")
        .otherwise("RESTORED")
    )
    return c.withColumn("outcome", outcome).select("mission", "outcome", F.when(F.col("outcome") == "RESTORED", F.col("_whole")).alias("restored"))


def span_totals(accounted: DataFrame, quality: str = "quality") -> DataFrame:
    """Totals over missions that are no fixtures; a median reduction only for two or more of them."""
    real = accounted.where(F.col(quality) != "SYNTHETIC")
    reduction = (1 - F.col("candidate_bytes") / F.col("raw_bytes")) * 100
    n = F.count("*")
    some = lambda c: F.when(n >= 2, c)
    return real.agg(
        n.alias("missions"), some(F.round(F.median(F.when(F.col("raw_bytes") > 0, reduction).otherwise(0.0)), 2)).alias("median_reduction_pct"),
        some(F.sum(F.col("reference_bytes") + F.col("duplicate_bytes"))).alias("proven_bytes"), some(F.sum("unknown_bytes")).alias("unknown_bytes"),
    )


# Bounds and keys of a compact manifest.
MOST_BYTES, MOST_ENTRIES, KEYS = 65_536, 4_096, ("e", "h", "m", "n", "s", "v")
MANIFEST = "e array<array<string>>, h string, m string, n bigint, s string, v string"
MANIFEST_VERSION = "MANIFEST_V1"


def encode_manifest(entries: Column, sha: Column, mission: Column, n: Column, assessment: Column) -> Column:
    """The one form of a manifest: sorted keys, no spaces, a line feed; null if it is too long."""
    text = F.concat(F.to_json(F.struct(entries.alias("e"), sha.alias("h"), mission.alias("m"), n.cast("long").alias("n"), assessment.alias("s"), F.lit(MANIFEST_VERSION).alias("v"))), F.lit("\n"))
    return F.when((F.octet_length(text) <= MOST_BYTES) & (F.size(entries) <= MOST_ENTRIES), text)


def parse_manifest(text: Column) -> Column:
    """(manifest, error) of a text; keys must be exactly the known ones, once each."""
    keys, m = F.json_object_keys(text), F.from_json(text, MANIFEST)
    error = (
        F.when(text.isNull() | (F.octet_length(text) == 0) | (F.octet_length(text) > MOST_BYTES), "LENGTH")
        .when(keys.isNull() | m.isNull(), "JSON")
        .when(F.array_sort(keys) != F.array(*map(F.lit, KEYS)), "FIELDS")
        .when(F.coalesce(F.size(m["e"]), F.lit(-1)) < 0, "ENTRIES")
        .when(F.size(m["e"]) > MOST_ENTRIES, "ENTRIES")
        .when(~F.coalesce(m["h"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "DIGEST")
        .when(~F.coalesce(m["s"].isin("NON_SENSITIVE", "SENSITIVE", "UNKNOWN"), F.lit(False)), "ASSESSMENT")
        .when(m["v"] != MANIFEST_VERSION, "VERSION")
    )
    return F.struct(F.when(error.isNull(), m).alias("manifest"), error.alias("error"))


def manifest_gain(proven: Column, manifest: Column) -> Column:
    """Proven bytes less what the manifest costs; may be negative."""
    return proven - F.octet_length(manifest)
