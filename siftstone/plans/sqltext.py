"""Fragments of ANSI SQL for the checks: the same levelling as in ``functions.levelling``."""

_MISSING = "('', 'n/a', 'na', 'unk', 'unknown', 'none', 'null', 'nil', '-', '--', '?')"


def known(x: str) -> str:
    return f"CASE WHEN ({x}) IN {_MISSING} THEN NULL ELSE ({x}) END"


def severity(c: str) -> str:
    low = f"lower(trim({c}))"
    return known(f"CASE {low} WHEN 'info' THEN 'informational' WHEN 'moderate' THEN 'medium' ELSE {low} END")


def cwe(c: str) -> str:
    return (
        f"TRY_CAST(coalesce(nullif(regexp_extract(lower({c}), 'cwe[^0-9a-z]*0*([0-9]{{1,7}})', 1), ''), "
        f"nullif(regexp_extract(lower({c}), '^\\s*0*([0-9]{{1,7}})\\s*$', 1), '')) AS INTEGER)"
    )


def path(c: str) -> str:
    p = f"regexp_replace(lower({c}), '\\s+', '', 'g')"
    p = f"regexp_replace({p}, '%2f|%5c|\\\\', '/', 'g')"
    p = f"regexp_replace({p}, '^file://', '')"
    p = f"regexp_replace({p}, '/+', '/', 'g')"
    p = f"regexp_replace({p}, '(^|/)(\\./)+', '\\1', 'g')"
    p = f"regexp_replace({p}, '^/+|/+$', '', 'g')"
    hop = "CASE WHEN b = '..' AND a <> '' AND NOT regexp_matches(a, '(^|/)\\.\\.$') THEN regexp_replace(a, '(^|/)[^/]+$', '') WHEN a = '' THEN b ELSE a || '/' || b END"
    return known(f"list_reduce(string_split({p}, '/'), lambda a, b: {hop})")


def tail(c: str) -> str:
    return f"array_to_string(list_reverse(list_reverse(string_split({path(c)}, '/'))[1:3]), '/')"


def repo(c: str) -> str:
    r = f"regexp_replace(lower({c}), '^\\s+|[\\s/]+$', '', 'g')"
    r = f"regexp_replace({r}, '\\.git$', '')"
    return known(f"regexp_replace(regexp_extract({r}, '([^/:\\\\]*)$', 1), '[\\s_]+', '-', 'g')")


SNAPSHOTS = """
done AS (
  SELECT coalesce(repo, chr(1)) || chr(2) || coalesce(application_id, chr(1)) AS stream, scan_id, started_at,
         nullif(lower(trim(target_sha)), '') AS sha
  FROM scans WHERE ended_at IS NOT NULL AND started_at IS NOT NULL),
stands AS (
  SELECT * FROM (SELECT *, lead(sha) OVER (PARTITION BY stream ORDER BY started_at, scan_id) AS next_sha FROM done)
  WHERE coalesce(next_sha <> sha, true)),
snaps AS (
  SELECT stream, scan_id, started_at, row_number() OVER (PARTITION BY stream ORDER BY started_at, scan_id) AS seq,
         lead(scan_id) OVER (PARTITION BY stream ORDER BY started_at, scan_id) AS next_scan_id
  FROM stands)
"""


def verdict(c: str) -> str:
    w = (
        f"regexp_replace(trim(coalesce(nullif(regexp_extract(lower({c}), '\"verdict\"\\s*:\\s*\"([^\"]*)\"', 1), ''), lower({c}))), '[\\s_\\-]+', ' ', 'g')"
    )
    return (
        f"CASE WHEN {w} IN ('confirm', 'confirmed', 'true positive', 'tp') THEN 'confirm' WHEN {w} IN ('reject', 'rejected', 'false positive', 'fp') "
        f"THEN 'reject' WHEN {w} IN ('uncertain', 'unsure', 'unk') THEN 'uncertain' END"
    )


def word(c: str) -> str:
    return known(f"regexp_replace(lower(trim({c})), '[\\s\\-]+', '_', 'g')")


LATEST = f"""
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY recorded_at DESC NULLS LAST,
    coalesce(path, '') DESC, coalesce(cwe, '') DESC, coalesce(severity, '') DESC) AS rn
    FROM findings WHERE scan_id IS NOT NULL AND finding_id IS NOT NULL) WHERE rn = 1),
f AS (
  SELECT scan_id, finding_id, {repo('repo')} AS repo, {severity('severity')} AS severity, {cwe('cwe')} AS cwe, {path('path')} AS path,
         regexp_extract({path('path')}, '([^/]*)$', 1) AS file, CAST(start_line AS BIGINT) AS line, {word('skill')} AS skill, confidence,
         {verdict('validator_verdict')} AS validator, {verdict('reviewer_verdict')} AS reviewer, reviewer_at, finding_json
  FROM latest)
"""
#: For queries that read the JSON: of rows recorded together, the one with the greater JSON text is the last.
LATEST_JSON = LATEST.replace("DESC NULLS LAST,", "DESC NULLS LAST, coalesce(finding_json, '') DESC,", 1)
SEV_NUM = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'informational' THEN 1 END"


def decoded(x: str, times: int = 2) -> str:
    """A JSON value, where it is text that holds JSON as what it holds."""
    for _ in range(times):
        held = f"({x}) ->> '$'"
        x = f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({held}, '^\\s*[\\[{{\"]') AND json_valid({held}) THEN CAST({held} AS JSON) ELSE {x} END"
    return x


def records(table: str, keys: str, column: str, wrapper: str, lists: dict[str, list[str]]) -> str:
    """CTEs whole and records(keys, list_name, list_pos, record): child objects of lists in JSON text, in any of the shapes delivered."""
    parts = []
    for name, paths in lists.items():
        for p in paths:
            at = "body"
            for step in p.split("."):
                at = f"({decoded(at + f" -> '$.{step}'", 1)})"
            parts.append(f"SELECT {keys}, '{name}' AS list_name, {at} AS list FROM whole")
    return f"""
whole AS (
  SELECT {keys}, CASE WHEN json_type(top, '$.{wrapper}') IS NOT NULL THEN {decoded(f"top -> '$.{wrapper}'", 1)} ELSE top END AS body
  FROM (SELECT {keys}, {decoded("j")} AS top FROM (SELECT {keys}, CASE WHEN json_valid({column}) THEN CAST({column} AS JSON) END AS j FROM {table} WHERE {column} IS NOT NULL))),
lists AS (SELECT {keys}, list_name, CASE json_type(list) WHEN 'OBJECT' THEN json_array(list) WHEN 'ARRAY' THEN list END AS list FROM ({" UNION ALL ".join(parts)})),
places AS (SELECT {keys}, list_name, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS list_pos FROM lists WHERE list IS NOT NULL),
records AS (SELECT * FROM (SELECT {keys}, list_name, CAST(list_pos AS INTEGER) AS list_pos, {decoded("json_extract(list, '$[' || list_pos || ']')", 1)} AS record FROM places)
  WHERE json_type(record) = 'OBJECT')
"""


FINDING_LISTS = {"locations": ["locations"], "votes": ["votes"], "evidence": ["evidence"], "taint_path": ["taint.taint_path", "taint_path"]}


def scalar(record: str, name: str) -> str:
    """A scalar member as text; none for lists, objects and nulls."""
    return f"CASE WHEN json_type({record}, '$.{name}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN {record} ->> '$.{name}' END"
