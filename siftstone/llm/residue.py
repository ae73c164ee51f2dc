"""Template residue, filler, error pages and script notices standing in documents as their own text.

Documents fall into sentences; numbers, ids, paths and quotations are levelled, code and quoted lines left out, and
equal sentences become one class. Trusted residue is what public software shows by default (``SEEDS``, the status phrases
of HTTP) and what its form gives away: Latin filler, one word or one sentence said over and over, text inside ``noscript``.

Near-duplicates carry the labels. Each class has a SimHash of its distinct character trigrams, cut into ``TABLES`` blocks
that stand in partitioned tables. Classes within ``TABLES * (flips + 1) - 1`` bits agree in some block but for ``flips`` bits, so
the few trusted classes look up all such values of each block, and the many classes of the corpus have one row per
block. Hamming distance and the similarity of the trigrams verify. A first hop from a seed needs ``SEED_SIMILARITY``; links
between classes of the corpus need ``LINK_SIMILARITY``, so that wording doesn't drift, and labels pass along them until
nothing new is reached: the connected components of the seeds.

Unfilled fields are told by form: marks that nothing else uses are certain, and the names in them make the vocabulary
that settles marks with other uses (``[name]``, ``${name}``). A sentence doesn't become a template by likeness to one with a gap.

Null and blank texts are no residue. Equal ids come out once. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.words import clean
from siftstone.session import spread, written

#: SimHash tables and the bits of a block; a class has 64 bits.
TABLES, BLOCK = 8, 8
#: Least similarity of trigram sets, and bits that may differ inside a block, for hops from seeds and between classes of the corpus.
SEED_SIMILARITY, SEED_FLIPS = 0.5, 2
LINK_SIMILARITY, LINK_FLIPS = 0.7, 1
#: A sentence of so many words that stands so often in a row, in at least such a share of the documents that hold it, is filler.
ROW_WORDS, ROW, ROW_SHARE = 3, 3, 0.2
#: Looked-up blocks are broadcast up to so many rows of 40 bytes; beyond, the join shuffles.
BROADCAST_PROBES = 200_000

# Sentences that public software shows by default in place of content: application skeletons, browsers,
# web servers, gateways, office programs and page builders.
SEEDS = """
You need to enable JavaScript to run this app.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Please enable JavaScript to continue using this application.
Please enable JavaScript to view this page.
JavaScript is disabled in your browser.
Please turn on JavaScript in your browser and reload the page.
Your browser does not support JavaScript.
This page requires JavaScript.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
Por favor, active JavaScript para ver esta página.
The requested URL was not found on this server.
The page could not be found.
The server encountered an internal error and could not complete your request.
You do not have permission to view this directory or page.
Access denied.
Sorry, something went wrong.
Application error: a client-side exception has occurred.
Checking your browser.
Your session has expired. Please sign in again.
This page is private or has been removed.
This content cannot be shown.
Slow down and try again later.
upstream closed the connection.
{"message": "Not Found", "status": "404"}
Seite nicht gefunden. Diese Seite gibt es nicht mehr.
Zugriff verweigert.
Error 403: prohibido. No tiene permiso para ver esta página.
Página no encontrada.
Your text here.
Your text goes here.
Click to add text.
Click to add a title.
Type your text here.
Enter a description.
This is placeholder text.
This is placeholder content.
Sample text, replace before publishing.
Copy to follow.
Hier steht Ihr Text.
Aquí va el texto.
""".strip().split("\n")
# Names of fields that letters have everywhere.
FIELD_SEEDS = ["first name", "last name", "full name", "company name", "email address", "phone number", "street address", "postal code", "job title", "start date", "end date"]
# The words of the usual Latin filler.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna"
    " aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in"
    " reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa"
    " qui officia deserunt mollit anim id est laborum".split()
)

_N = r"[A-Za-z][A-Za-z0-9]*(?:[ _][A-Za-z0-9]+){0,2}"
# Marks that stand for an unfilled field and nothing else; the groups hold the name.
_CERTAIN = re.compile(
    rf"\{{\{{\s*({_N})\s*\}}\}}|\[\[\s*({_N})\s*\]\]|<<\s*({_N})\s*>>|<%=?\s*({_N})\s*%>|«\s*({_N})\s*»|@@({_N})@@|XX_({_N})_XX|\[(?:insert|enter|add|INSERT|ENTER|ADD|Insert|Enter|Add)\s({_N})\]"
    rf"|<({_N})\sgoes here>|\(to be (?:completed|added|filled in|determined)(?::\s*({_N}))?\)|(?<![$#{{%])\{{\d{{1,2}}\}}(?!\}})"
)
# Marks with other uses too: shell and format strings, labels.
_POSSIBLE = re.compile(
    rf"[$#]\{{\s*({_N})\s*\}}|\$({_N})\$|%({_N})%|%\(({_N})\)s|__({_N})__|\[({_N})\]|(?<![$#{{%])\{{({_N})\}}(?!\}})"
)
_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_LINE = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
_SENTENCE = re.compile(r"(?<=[.?!…])\s+")
_MARKED = re.compile(r"(?<=[.?!…])\s+|</?(?:html|head|title|body|center|div|p|h[1-6]|hr|br|ul|ol|li|table|tr|td|th|noscript)(?:\s[^<>]*)?/?>", re.I)
_NOSCRIPT = re.compile(r"<noscript(?:\s[^<>]*)?>(.*?)</noscript>", re.I | re.S)
_QUOTED = re.compile(r"""“[^”\n]*”|„[^“”\n]*[“”]|"[^"\n]*"|(?<!\w)'[^'\n]*'(?!\w)""")
# What every field has somewhere; other sentences need no closer look.
_MAYBE_FIELD = re.compile(r"[{\[<«$%@]|__|XX_|\(to be ", re.I)
_WORD = re.compile(r"[\w$]+(?:['’./\\\-:]+[\w$]+)*|/[\w./\-]+")
_PLAIN = frozenset(("in", "do", "id", "ad", "et", "ex", "est", "non", "qui"))
_FIELD_WORD = "ƒield"
#: Kinds of rows that a text gives: a sentence, a sign certain by its form, a name in a certain field, one in a possible field, and a
#: sentence that stands in a row.
SENTENCE, CERTAIN, NAME, POSSIBLE, IN_A_ROW = range(5)


def _level(w: str) -> str:
    """One word of a class: numbers, ids, paths and marks in capitals as ``#``, filler as ``latin``."""
    low = w.lower().strip("/.'’-:")
    if not low or re.fullmatch(r"[45]\d\d", low):
        return low
    if re.search(r"[\d_/\\.$]", w) or re.search(r"[a-z][A-Z]", w) and low != "javascript" or re.fullmatch(r"[A-Z]{7,}", w):
        return "#"
    return "latin" if low in LATIN_FILLER and low not in _PLAIN else low


def sentence_class(sentence: str, levels: dict[str, str]) -> tuple[str, bool]:
    """A sentence as its class (numbers, ids and paths levelled, a word repeated in a row once), and whether its form gives it
    away as filler. ``levels`` remembers levelled words.
    """
    out: list[str] = []
    n = 0
    for w in _WORD.findall(clean(sentence)):
        low = levels.get(w)
        if low is None:
            low = levels[w] = _level(w)
        if low:
            n += 1
            if not out or out[-1] != low:
                out.append(low)
    if "latin" in out and not set(out) - LATIN_FILLER - {"latin"}:
        return "latin", True
    return " ".join(out), n >= 3 and len(out) == 1 and out[0].isalpha()


def unquoted(sentence: str) -> str:
    """A sentence with its quotations levelled; bodies in braces are read as they are."""
    if sentence[0] not in "{[" and any(q in sentence for q in "\"'“„"):
        return _QUOTED.sub(" quoted ", sentence)
    return sentence


def _noted(m: re.Match, kind: int, found: list[tuple[int, str]]) -> str:
    """What a field leaves in its sentence; its kind and the name in it go to ``found``."""
    name = next((g for g in m.groups() if g), "").lower().replace("_", " ")
    if kind == CERTAIN:
        found.append((CERTAIN, "field"))
        if name:
            found.append((NAME, name))
    else:
        found.append((POSSIBLE, name))
    return f" {_FIELD_WORD} "


def signs(text: str, levels: dict[str, str]) -> Iterator[tuple[int, str]]:
    """(kind, sentence or name) of all a text holds, without code and quoted lines."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<noscript" in text.lower():
        for m in _NOSCRIPT.finditer(text):
            if len(_WORD.findall(clean(m.group(1)))) >= 2 and "`" not in text[max(0, m.start() - 1) : m.end() + 1]:
                yield CERTAIN, "noscript"
    before, row = "", 0
    for line in _LINE.split(text):
        line = line.strip()
        if not line or line[0] == ">":
            continue
        if "`" in line:
            line = re.sub(r"`[^`]*`", " quoted ", line)
        for s in (_MARKED if "<" in line else _SENTENCE).split(line):
            if not s:
                continue
            row = row + 1 if s == before else 1
            before = s
            s = unquoted(s)
            if _MAYBE_FIELD.search(s):
                found: list[tuple[int, str]] = []
                s = _CERTAIN.sub(lambda m: _noted(m, CERTAIN, found), s)
                s = _POSSIBLE.sub(lambda m: _noted(m, POSSIBLE, found), s)
                yield from found
            c, filler = sentence_class(s, levels)
            if filler:
                yield CERTAIN, "filler"
            if c:
                yield SENTENCE, c
                if row == ROW and sum(w.isalpha() for w in c.split()) >= ROW_WORDS:
                    yield IN_A_ROW, c
                head, colon, rest = s.partition(": ")
                if colon and rest and s[0] != "{":
                    c = sentence_class(head, levels)[0]
                    if c.count(" ") >= 2:
                        yield SENTENCE, c


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    levels: dict[str, str] = {}
    for batch in batches:
        if len(levels) > 500_000:
            levels.clear()
        ids: list[int] = []
        kinds: list[int] = []
        codes: list[int] = []
        texts: list[str] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, c in set(signs(text, levels)):
                ids.append(i)
                kinds.append(kind)
                codes.append(xxhash.xxh3_64_intdigest(c) - 2**63)
                texts.append(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(codes, pa.int64()), pa.array(texts, pa.string()), pa.array(kinds, pa.int32())], names=["doc_id", "cls", "sentence", "kind"]
        )


def trigram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, trigram) for every distinct character trigram of every text, sorted; blanks stand at both ends."""
    points = [np.frombuffer(f" {t} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) for t in texts]
    sizes = np.array([len(p) - 2 for p in points])
    grams = [p[:-2] | (p[1:-1] << np.uint64(21)) | (p[2:] << np.uint64(42)) for p in points]
    place = np.repeat(np.arange(len(texts)), sizes)
    flat = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
    order = np.lexsort((flat, place))
    place, flat = place[order], flat[order]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (flat[1:] != flat[:-1])] if len(flat) else np.empty(0, dtype=bool)
    return place[fresh], flat[fresh]


def simhashes(place: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit SimHash of each text's trigrams."""
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    out = np.zeros(n, dtype=np.uint64)
    if len(h):
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        for bit in range(64):
            votes = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            out[place[starts]] |= (2 * votes > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def _hash_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf.sentence.tolist()
        place, grams = trigram_sets(texts)
        ends = np.searchsorted(place, np.arange(len(texts) + 1))
        sets = [grams[a:b].view(np.int64) for a, b in zip(ends[:-1], ends[1:])]
        yield pd.DataFrame({"cls": pdf.cls, "simhash": simhashes(place, grams, len(texts)).view(np.int64), "grams": sets})


def default_seeds() -> list[str]:
    """Defaults of public software and the phrases of HTTP: with their codes, and without where they have three words."""
    phrases = [s for s in HTTPStatus if s.value >= 400]
    return SEEDS + [f"{s.value} {s.phrase}" for s in phrases] + [s.phrase for s in phrases if s.phrase.count(" ") >= 2]


def known_classes(spark: SparkSession, seeds: list[str] | None = None) -> DataFrame:
    """(cls, sentence): the classes of seeds."""
    texts = sorted({c for s in (default_seeds() if seeds is None else seeds) for kind, c in signs(s, {}) if kind == SENTENCE})
    return spark.createDataFrame([(xxhash.xxh3_64_intdigest(c) - 2**63, c) for c in texts], "cls long, sentence string")


def _block(k: int) -> Column:
    return F.shiftrightunsigned("simhash", k * BLOCK).bitwiseAND(2**BLOCK - 1).cast("int")


def simhash_tables(hashed: DataFrame) -> DataFrame:
    """(table, block, cls, simhash, size): one row per class and table."""
    blocks = F.array(*(F.struct(F.lit(k).alias("table"), _block(k).alias("block")) for k in range(TABLES)))
    return hashed.select(F.explode(blocks).alias("b"), "cls", "simhash", F.size("grams").alias("size")).select("b.table", "b.block", "cls", "simhash", "size")


def near_classes(tables: DataFrame, hashed: DataFrame, frontier: DataFrame, flips: int, least: float) -> DataFrame:
    """(from, cls): classes whose SimHash and trigrams are near those of a class in ``frontier`` (cls, simhash, grams).

    Sizes of sets as similar as ``least`` differ at most by that factor, which rules out most pairs before the bits are counted.
    """
    masks = [m for m in range(2**BLOCK) if m.bit_count() <= flips]
    flip = frontier.sparkSession.createDataFrame(pd.DataFrame({"mask": masks}))
    # The masks are a fixed list, so this is one row per class of the frontier, table and mask.
    probes = written(
        simhash_tables(frontier)
        .withColumnsRenamed({"cls": "from", "simhash": "from_hash", "size": "from_size"})
        .crossJoin(F.broadcast(flip))
        .withColumn("block", F.col("block").bitwiseXOR(F.col("mask").cast("int")))
        .drop("mask"),
        "probes",
    )
    if probes.count() <= BROADCAST_PROBES:
        probes = F.broadcast(probes)
    bits = F.bit_count(F.col("simhash").bitwiseXOR(F.col("from_hash")))
    alike = (F.col("size") >= F.col("from_size") * least) & (F.col("from_size") >= F.col("size") * least)
    near = tables.join(probes, ["table", "block"]).where(alike & (bits < TABLES * (flips + 1))).select("from", "cls").distinct()
    sets = near.join(hashed.select("cls", "grams"), "cls").join(frontier.select(F.col("cls").alias("from"), F.col("grams").alias("held")), "from")
    shared = F.size(F.array_intersect("grams", "held"))
    return sets.where(shared >= (F.size("grams") + F.size("held") - shared) * (least - 1e-9)).select("from", "cls")


def residue_classes(classes: DataFrame, trusted: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """(cls, hops): classes (cls, sentence) that are seeds or ``trusted`` (cls) (0 hops) or reached from them by verified links."""
    spark = classes.sparkSession
    hashed = written(classes.select("cls", "sentence").dropDuplicates(["cls"]).mapInPandas(_hash_classes, "cls long, simhash long, grams array<long>"), "simhashes")
    tables = written(simhash_tables(hashed), "simhash-tables")
    frontier = written(known_classes(spark, seeds).mapInPandas(_hash_classes, hashed.schema), "frontier")
    reached = written(frontier.select("cls").unionByName(trusted.select("cls")).distinct().withColumn("hops", F.lit(0)), "reached")
    hops, flips, least = 0, SEED_FLIPS, SEED_SIMILARITY
    while True:
        hops += 1
        found = near_classes(tables, hashed, frontier, flips, least).select("cls").distinct().join(reached, "cls", "left_anti")
        fresh = written(found.select("cls", F.lit(hops).alias("hops")), "reached")
        if hops > 1 and fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh)
        # Seeds and trusted classes that stand in the corpus pass labels on like the classes they reach.
        starts = fresh if hops > 1 else reached
        frontier = written(hashed.join(starts.select("cls"), "cls", "left_semi"), "frontier")
        flips, least = LINK_FLIPS, LINK_SIMILARITY


def residue_documents(documents: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """(doc_id, n_residue, by_form, hops): documents that hold residue: how many classes of it, whether a form gave it away, and
    the fewest links from a seed to a class it holds (null if only the form speaks)."""
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    held = written(spread(texts).mapInArrow(_split, "doc_id long, cls long, sentence string, kind int"), "signs", ["kind"])
    kind = lambda k: held.where(F.col("kind") == k)
    classes = kind(SENTENCE).groupBy("cls").agg(F.first("sentence").alias("sentence"))
    rows = kind(IN_A_ROW).groupBy("cls").agg(F.countDistinct("doc_id").alias("in_a_row"))
    holding = kind(SENTENCE).join(rows, "cls").groupBy("cls", "in_a_row").agg(F.countDistinct("doc_id").alias("held"))
    trusted = written(holding.where(F.col("in_a_row") >= F.col("held") * ROW_SHARE).select("cls"), "trusted")
    reached = residue_classes(classes, trusted, seeds)
    linked = kind(SENTENCE).select("doc_id", "cls").join(reached, "cls").select("doc_id", "cls", "hops", F.lit(False).alias("form"))
    common = documents.sparkSession.createDataFrame([(n,) for n in FIELD_SEEDS], "sentence string")
    names = kind(NAME).select("sentence").unionByName(common).distinct()
    fields = kind(POSSIBLE).join(names, "sentence", "left_semi").unionByName(kind(CERTAIN)).unionByName(kind(IN_A_ROW).join(trusted, "cls", "left_semi").select(*held.columns))
    formed = fields.select("doc_id", "cls", F.lit(None).cast("int").alias("hops"), F.lit(True).alias("form"))
    return linked.unionByName(formed).groupBy("doc_id").agg(F.countDistinct("cls").alias("n_residue"), F.bool_or("form").alias("by_form"), F.min("hops").alias("hops"))
