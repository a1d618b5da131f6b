"""Information-theoretic sanitisation of personal data.

Patterns find protected entities. How strongly a term reveals an entity is its pointwise mutual information with it in the
corpus over the information of the entity: 1 if the term occurs beside that entity only. Terms that disclose more than a
threshold are generalised or removed together with the entities. The mutual information is lowered by what so few texts
leave uncertain, so that entities of a single text are protected too, by weaker terms.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import WORD_PATTERN, ship, word_array, words_of

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 8
GENERALISE, REMOVE = 0.85, 0.95
MOST_BROADCAST = 200_000
SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The patterns of protected entities. A digit run is never entered midway, so each pattern is linear.
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(WORD_PATTERN)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from left to right, found from their @ signs so that long runs of letters cost one pass."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of protected entities in code points, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _normal(word: str) -> bytes:
    return word.encode().lower()


def _value(kind: str, text: str) -> str:
    return f"{kind}:{text.lower()}" if kind == "email" else f"{kind}:{re.sub('[^0-9.]' if kind == 'ip' else '[^0-9]', '', text)}"


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document with entities: which ones, and the distinct terms near each."""
    for batch in batches:
        texts, entities, terms = [], [], []
        for value in batch.column(0):
            text = value.as_py()
            if not text:
                continue
            spans = base_spans(text)
            if not spans:
                continue
            near: dict[str, set[str]] = {}
            covered = sorted((a, b) for _, a, b in spans)
            words, i = [], 0
            for m in WORD.finditer(text):
                while i < len(covered) and covered[i][1] <= m.start():
                    i += 1
                if i == len(covered) or m.end() <= covered[i][0]:
                    words.append(m.span())
            starts = [a for a, _ in words]
            for kind, a, b in spans:
                own = near.setdefault(_value(kind, text[a:b]), set())
                left = bisect_left(starts, a)
                right = bisect_left(starts, b)
                for x, y in words[max(0, left - CONTEXT):left] + words[right:right + CONTEXT]:
                    own.add(_normal(text[x:y]).decode())
            key = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
            for entity, found in near.items():
                texts.append(key)
                entities.append(entity)
                terms.append(sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(entities, pa.string()), pa.array(terms, pa.list_(pa.string()))],
                                         names=["text_key", "entity", "terms"])


def disclosures(docs: DataFrame, floor: float = GENERALISE) -> DataFrame:
    """``term, disclosure``: terms that reveal some entity at ``floor`` or more.

    With N rows of text, df(e) rows that hold an entity, df(t) rows that hold a term and df(t, e) rows where the term is
    within eight words of the entity, in n different texts, disclosure =
    log(N df(t, e) / (df(t) df(e)) n / (n + 1)) / log(N / df(e)). The factor n / (n + 1) is the rule of succession: the term
    counts as if one further text held it without the entity. So a term beside an entity of one text loses log 2, which
    a corpus of about a hundred rows makes up for, and one seen in many texts next to nothing; copies of a text add nothing
    to n, and no number of texts is asked for.

    Entities and contexts are few, so pairs are summed before they are shuffled. Terms are counted over the whole corpus;
    only those beside an entity are, and counts are combined before the shuffle. Pairs of a term with equal counts score
    alike and are scored once, so a word beside very many entities is a few rows.
    """
    seen = docs.where("text IS NOT NULL").select("text").mapInArrow(_scanned, "text_key long, entity string, terms array<string>")
    seen = stage(seen, "entities")
    entities = seen.groupBy("entity").agg(F.count("*").alias("df_e"))
    pairs = seen.select("entity", F.explode("terms").alias("term"), "text_key")
    # The sum over copies of a text first, then over different texts.
    pairs = pairs.groupBy("entity", "term", "text_key").agg(F.count("*").alias("rows"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("df_te"), F.count("*").alias("texts"))
    pairs = stage(pairs.join(entities, "entity").groupBy("term", "df_te", "texts", "df_e").agg(F.count("*").alias("alike")), "pairs")
    terms = stage(pairs.select("term").distinct(), "terms")
    held = docs.where("text IS NOT NULL").select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("term"))
    if terms.count() <= MOST_BROADCAST:
        df_t = held.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df_t"))
    else:
        df_t = held.groupBy("term").agg(F.count("*").alias("df_t"))  # combined per task before any shuffle
    n = F.lit(float(docs.where("text IS NOT NULL").count()))
    lowered = F.col("df_te") * F.col("texts") / (F.col("texts") + 1)
    share = F.log(n * lowered / (F.col("df_t").cast("double") * F.col("df_e"))) / F.log(n / F.col("df_e"))
    scored = pairs.join(df_t, "term").where(n > F.col("df_e")).withColumn("disclosure", share).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return scored.where(F.col("disclosure") >= floor)


def shape(word: str) -> str:
    """What is left of a generalised term: whether it is a number, a name or a word."""
    return "[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "[WORD]"


def sanitised(text: str, actions: dict[bytes, bool]) -> tuple[list[Span], list[Span], str]:
    """Base spans, term spans and the text with entities masked, terms removed (True) or generalised (False)."""
    base = base_spans(text)
    terms: list[Span] = []
    if actions and any(w in actions for w in set(words_of(text.encode()))):
        covered, i = sorted((a, b) for _, a, b in base), 0
        for m in WORD.finditer(text):
            while i < len(covered) and covered[i][1] <= m.start():
                i += 1
            if (i == len(covered) or m.end() <= covered[i][0]) and _normal(m[0]) in actions:
                terms.append(("term", *m.span()))
    out, upto = [], 0
    for kind, a, b in sorted([*base, *terms], key=lambda s: (s[1], -s[2])):
        if a < upto:
            upto = max(upto, b)  # within or across a span that is masked already
            continue
        put = f"[{kind.upper()}]" if kind != "term" else "" if actions[_normal(text[a:b])] else shape(text[a:b])
        out += [text[upto:a], put]
        upto = b
    return base, terms, "".join([*out, text[upto:]])


def _apply(actions_of, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised")}
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            shared = actions_of() if own is None else None
            for row, value in enumerate(batch.column(1)):
                actions = shared if own is None else {t["term"].encode(): t["gone"] for t in own[row] or []}
                base, terms, text = sanitised(value.as_py() or "", actions)
                for kind in KINDS:
                    columns[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined([*base, *terms]))
                columns["sanitised"].append(text if with_text and value.is_valid else None)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(columns.values(), kinds))], names=["doc_id", *columns])

    return run


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, with_text: bool = True,
             most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised`` for every row of ``doc_id, text``.

    Spans are ``kind:start:end`` in code points, base spans by kind and start, then those of terms outside them. The
    sanitised text has base spans masked by kind, terms of a disclosure of ``remove`` or more removed and those of
    ``generalise`` or more replaced by their shape. Null and empty texts have no spans, a null text stays null; repeated
    rows give a row each (their copies make no term more certain); an empty table gives an empty result; other columns are not read.

    The terms found are sent to the executors if there are at most ``most_broadcast`` of them; any larger number is joined
    to the words of the documents instead.
    """
    spark = docs.sparkSession
    found = stage(disclosures(docs, generalise).select("term", (F.col("disclosure") >= remove).alias("gone")), "disclosing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SPANS}, sanitised string"
    if found.count() <= most_broadcast:
        sent = spark.sparkContext.broadcast({r["term"].encode(): r["gone"] for r in found.collect()})
        return docs.select("doc_id", "text").mapInArrow(_apply(lambda: sent.value, with_text), schema)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    words = rows.select("row", F.explode(F.array_distinct(word_array(F.col("text")))).alias("term")).join(found, "term")
    per_row = words.groupBy("row").agg(F.collect_list(F.struct("term", "gone")).alias("own"))  # at most the words of one text
    return rows.join(per_row, "row", "left").select("doc_id", "text", "own").mapInArrow(_apply(None, with_text), schema)
