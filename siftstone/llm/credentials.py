"""Credentials in source code, found through a trigram index and masked in place.

Every detection pattern yields, from its parse tree, alternatives of trigrams that a match must
hold. Chunks are indexed by trigram; intersecting postings gives the chunks in which a pattern can
match at all, and only those are read by the patterns. Equal chunks are indexed once.

Null and empty snippets hold nothing. A credential counts when it would work as written: values that
are references, stand-ins, masked or plain names don't. Hits that repeat a snippet all come out.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "********"
PIECE = 200

_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|secret_?key|private_?key|credential)"
# A name starts where no name goes on, so a long run of letters is read once.
_KEY = rf"(?<![\w.\-])[\w.\-]*{_NAME}(?:[_\-.]\w+|s)?"
_QUOTED = r"""(?:"(?P<v1>[^"\n]+)"|'(?P<v2>[^'\n]+)')"""

# Detection patterns by name; the groups v, v1, v2 hold the secret part.
PATTERNS: dict[str, str] = {
    "cloud_key_id": r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])",
    "code_host_token": r"(?<![A-Za-z0-9])(?P<v>(?:ghp_|gho_|ghs_|ghu_|ghr_|github_pat_|glpat-)[A-Za-z0-9_\-]{16,})",
    "model_api_key": r"(?<![A-Za-z0-9])(?P<v>sk-(?:ant-)?[A-Za-z0-9_\-]{12,})",
    "search_api_key": r"(?<![A-Za-z0-9])(?P<v>AIza[0-9A-Za-z_\-]{30,})",
    "chat_token": r"(?<![A-Za-z0-9])(?P<v>xox[abeoprs]-[0-9A-Za-z\-]{10,})",
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:(?!-----END)[\s\S]){24,})",
    "url_password": r"""(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*://[^\s:/@"']*:(?P<v>[^\s/@"']+)@[\w.\-]""",
    "bearer_token": r"Bearer\s+(?P<v>[A-Za-z0-9._~+/=\-]{12,})",
    "basic_auth": r"Basic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})",
    "chat_hook": r"""hooks\.[^\s"'/]+/services/\w+/\w+/(?P<v>\w{12,})""",
    "storage_key": r"AccountKey=(?P<v>[A-Za-z0-9+/]{32,}={0,2})",
    "connection_password": r"""(?:Pwd|Password)=(?P<v>[^;"'\n]+)\s*;""",
    "curl_user": r"""curl[^\n]*\s(?:-u|--user)[\s=]+["']?[^\s:"'$]+:(?P<v>[^\s"'$]+)""",
    "api_key_header": r"""(?:X-Api-Key|Api-Key|X-Auth-Token|Private-Token)["']?\s*[:=,]\s*["']?(?P<v>[^\s"']{8,})""",
    "client_password": r"""(?:mysql|mysqldump|mysqladmin|mariadb)\s[^\n]*\s-p(?P<v>[^\s"']+)""",
    "auth_pair": rf"""(?:auth\s*=\s*\(|\.login\(|basic_auth\()\s*["'][^"'\n]*["']\s*,\s*{_QUOTED}""",
    "signing_secret": rf"""jwt\.(?:encode|decode)\(\s*[\w.]+\s*,\s*{_QUOTED}""",
    "compared_secret": rf"""(?:given|supplied|entered|provided|{_NAME})\w*\s*={{2,3}}\s*{_QUOTED}""",
    "assigned_secret": rf"""{_KEY}["']?\]?\s*(?::=|=>|=|:)\s*[bru]{{0,2}}{_QUOTED}""",
    "joined_secret": rf"""{_KEY}\s*=\s*\w+\s*\+\s*{_QUOTED}""",
    "default_secret": rf"""(?:environ\.get|getenv|env\.get|config\.get|ENV\.fetch)\(\s*["'][^"'\n]*["']\s*,\s*{_QUOTED}""",
    "attribute_secret": rf"""(?:key|name)=["']{_KEY}["']\s+value={_QUOTED}""",
    "exported_secret": rf"""(?:export|ENV|set|setx)\s+{_KEY}[= ](?P<v>[^\s"'$&;]+)""",
    "yaml_secret": rf"""(?:^|\n)\s*(?:-\s+)?["']?{_KEY}["']?:[ \t]+(?P<v>[^\s"'{{$&*|>]\S*)""",
}
_IGNORE_CASE = {
    "url_password", "bearer_token", "basic_auth", "connection_password", "api_key_header", "compared_secret",
    "assigned_secret", "joined_secret", "attribute_secret", "exported_secret", "yaml_secret",
}

# Words that show a value to be a stand-in.
_STAND_IN = re.compile(
    r"example|redacted|masked|placeholder|change[\s_\-]?(?:me|it)|replace[\s_\-]?(?:me|this|with)|dummy|insert[\s_\-]|your[\s_\-]"
    r"|goes[\s_\-]?here|(?<![a-z0-9])to[\s_\-]?do(?![a-z0-9])|fill[\s_\-]?(?:me|in)|not[\s_\-]?set|undefined|sample[\s_\-]",
    re.I,
)
_REFERENCE = re.compile(r"^\s*(?:\$|\{|#\{|<|%\w+%$|%\(|__\w+__$|\[\w*\]$|@@|env[.:(]|vault[:.]|os\.|process\.env|secrets?\.|ref\+|arn:)", re.I)
_REPEATED = re.compile(r"(.)\1{7,}|^(?:[xX*.\-#0]+)$|\*{3,}|x{6,}|\.{3}|…", re.I)
# Values that name a field, a kind or a state rather than being a secret: several plain words, or one that says what a field holds.
_PLAIN_WORDS = re.compile(r"^[a-z]+(?:[\s_\-.:/][a-z]+)+[:.]?$|^[A-Z]+(?:[_\-][A-Z]+)+$")
_SAYS_KIND = re.compile(rf"^(?:\w*{_NAME}s?|bearer|basic|digest|none|null|nil|true|false|yes|no|string|text|str|int|integer|bool|boolean|required|optional|hidden|enabled|disabled|default)$", re.I)
# Keys that hold the name or the kind of something secret.
_NAMES_FIELD = re.compile(r"(?:field|name|type|label|kind|header|param|attribute|column|prompt|hint|title)s?[\"'\]]*\s*(?::=|=>|=|:)", re.I)
#: Patterns whose form alone tells a secret; only stand-ins are told from them.
_BY_FORM = {"cloud_key_id", "code_host_token", "model_api_key", "search_api_key", "chat_token", "chat_hook", "storage_key"}


def live(value: str) -> bool:
    """Whether a value would work as written, rather than stand for one kept elsewhere."""
    v = value.strip()
    if not v or _REFERENCE.search(v) or _REPEATED.search(v) or _STAND_IN.search(v):
        return False
    if "{{" in v or "${" in v or "{" in v and "}" in v and " " not in v and re.search(r"\{\w*\}", v):
        return False
    return not (_PLAIN_WORDS.match(v) or _SAYS_KIND.match(v))


def _live_match(name: str, value: str) -> bool:
    if name == "basic_auth":
        try:
            user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4)).decode().partition(":")
        except (binascii.Error, ValueError):
            return False
        return bool(colon) and live(password)
    if name == "private_key":
        body = re.sub(r"\\n|\s|Proc-Type.*|DEK-Info.*", "", value)
        return len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 24 and not _REPEATED.search(body) and not _STAND_IN.search(body)
    if name in _BY_FORM:
        return not _REPEATED.search(value) and not _STAND_IN.search(value)
    return live(value)


def spans(text: str, names: list[str], compiled: dict[str, re.Pattern]) -> list[tuple[int, int]]:
    """Places of the secret parts, without overlaps."""
    found: list[tuple[int, int]] = []
    for name in names:
        for m in compiled[name].finditer(text):
            for group in ("v", "v1", "v2"):
                if group in m.re.groupindex and m.group(group) is not None and _live_match(name, m.group(group)):
                    # One plain word beside a key that holds names or kinds is such a name.
                    if not (m.group(group).strip().isalpha() and _NAMES_FIELD.search(m.group(0))):
                        found.append(m.span(group))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def compiled_patterns() -> dict[str, re.Pattern]:
    return {n: re.compile(p, re.I if n in _IGNORE_CASE else 0) for n, p in PATTERNS.items()}


def redact(text: str, places: list[tuple[int, int]]) -> str:
    """Text with each secret part masked; line breaks inside a part stay, so the code keeps its lines."""
    out, last = [], 0
    for a, b in places:
        inner = re.split(r"(\n|\\n)", text[a:b])
        out += [text[last:a], "".join(x if x in ("\n", "\\n", "") else MASK for x in inner)]
        last = b
    return "".join([*out, text[last:]])


def required_trigrams(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams: each match holds all of at least one alternative.

    Derived from the parse tree: literal runs in sequence give trigrams, branches give alternatives,
    optional parts and classes give none and end a run. One empty alternative means: read every chunk.
    """

    def runs(items) -> list[list[str]]:
        """Alternatives, each a list of literal runs; the first and the last may still grow."""
        alternatives: list[list[str]] = [[""]]

        def extend(choices: list[list[str]]) -> None:
            nonlocal alternatives
            out = []
            for left in alternatives:
                for right in choices:
                    out.append([*left[:-1], left[-1] + right[0], *right[1:]])
            # Only runs that hold a trigram matter, besides the first and last, which may still grow.
            out = [list(x) for x in dict.fromkeys((*a[:1], *(r for r in a[1:-1] if len(r) >= 3), *a[1:][-1:]) for a in out)]
            alternatives = out if len(out) <= most else [[*a, ""] for a in alternatives]

        for op, arg in items:
            if op is C.LITERAL:
                extend([[chr(arg)]])
            elif op is C.SUBPATTERN:
                extend(runs(arg[3]))
            elif op is C.BRANCH:
                extend([r for branch in arg[1] for r in runs(branch)])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                if (low, high) == (0, 1):
                    extend([[""], *runs(inner)])
                elif low >= 1:
                    first = runs(inner)
                    extend(first if low == high == 1 else [[*r, ""] for r in first])
                else:
                    extend([["", ""]])
            elif op in (C.AT, C.ASSERT_NOT):
                continue
            elif op is C.ASSERT:
                continue
            else:
                extend([["", ""]])
        return alternatives

    found = set()
    for parts in runs(parser.parse(pattern)):
        found.add(frozenset(run[i : i + 3].lower() for run in parts for i in range(len(run) - 2)))
    # An alternative that holds all of another one adds nothing.
    return [a for a in found if not any(b < a for b in found)]


def trigram_index(chunks: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Postings (trigram, chunk) of every chunk's lower-case text; ``wanted`` limits the trigrams kept."""
    # Text is cut into short pieces that overlap by two letters, as reaching into a long string costs its length.
    pieces = F.regexp_extract_all("low", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    joined = F.expr("transform(pieces, (x, i) -> concat(x, coalesce(left(get(pieces, i + 1), 2), '')))")
    grams = "transform(sequence(1, length(x) - 2), i -> substring(x, i, 3))"
    grams = f"case when length(x) < 3 then cast(array() as array<string>) else array_distinct({grams}) end"
    if wanted is not None:
        listed = ", ".join("'" + g.replace("\\", "\\\\").replace("'", "\\'") + "'" for g in wanted)
        grams = f"array_intersect({grams}, array({listed}))"
    return (
        chunks.select("chunk", F.lower("text").alias("low"))
        .select("chunk", pieces.alias("pieces"))
        .select("chunk", joined.alias("pieces"))
        .select(F.explode(F.expr(f"array_distinct(flatten(transform(pieces, x -> {grams})))")).alias("trigram"), "chunk")
    )


def _chunk_id(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def secret_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk, redacted, n_secrets) for every chunk (chunk, text) that holds a live credential."""
    spark = chunks.sparkSession
    clauses = [(n, k, g) for n, p in PATTERNS.items() for k, a in enumerate(required_trigrams(p)) for g in a]
    needs = [(n, k, len(a)) for n, p in PATTERNS.items() for k, a in enumerate(required_trigrams(p))]
    if any(not size for _, _, size in needs):
        raise ValueError("a pattern without a literal run of three letters can't use the index")
    # The catalogue is bounded by the number of patterns, whatever the data.
    clause_table = F.broadcast(spark.createDataFrame(clauses, "pattern string, alternative int, trigram string"))
    size_table = F.broadcast(spark.createDataFrame(needs, "pattern string, alternative int, needed long"))
    candidates = (
        trigram_index(chunks, sorted({g for _, _, g in clauses}))
        .join(clause_table, "trigram")
        .groupBy("chunk", "pattern", "alternative")
        .agg(F.count("*").alias("held"))
        .join(size_table, ["pattern", "alternative"])
        .where("held = needed")
        .groupBy("chunk")
        .agg(F.collect_set("pattern").alias("patterns"))
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = compiled_patterns()
        for pdf in batches:
            rows = []
            for a, b, text, names in zip(pdf.a, pdf.b, pdf.text, pdf.patterns):
                places = spans(text, list(names), compiled)
                if places:
                    rows.append((a, b, redact(text, places), len(places)))
            yield pd.DataFrame(rows, columns=["a", "b", "redacted", "n_secrets"])

    read = chunks.join(candidates, "chunk").select("chunk.a", "chunk.b", "text", "patterns")
    found = read.mapInPandas(verify, "a long, b long, redacted string, n_secrets long")
    return found.select(F.struct("a", "b").alias("chunk"), "redacted", "n_secrets")


def find_secrets(hits: DataFrame, id_col: str = "hit_id", text_col: str = "snippet") -> DataFrame:
    """(id, redacted, n_secrets) for every row whose text holds a live credential."""
    rows = hits.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col), F.col(text_col).alias("text"), _chunk_id(F.col(text_col)).alias("chunk")
    )
    chunks = rows.groupBy("chunk").agg(F.first("text").alias("text"))
    return rows.select(id_col, "chunk").distinct().join(secret_chunks(chunks), "chunk").select(id_col, "redacted", "n_secrets")
