"""Personal data by information-theoretic sanitisation.

Base spans (email, ip, card, phone) are the protected entities: each normalised value, and each kind as a class of its own. A term is
a word, lower-cased and without the marks around it. It discloses an entity e as far as seeing it tells of e:

    P(e | t) = (df(e, t) + PSEUDO P(e)) / (df(t) + PSEUDO)     disclosure = ln(P(e | t) / P(e)) / ln(1 / P(e))

the smoothed pointwise mutual information over the entity's information content: 0 when t tells nothing, 1 when t gives e away.
P(e) = df(e) / N; df counts all documents; df(e, t) counts those in which t stands within WINDOW words of e. Every co-occurrence
counts, even a single one, whose estimate the pseudo-counts hold back. A term must also make its entity LIKELY, so that of
frequent terms beside rare entities none is taken for the share of information alone.

Terms at or above GENERALISE are spans of kind `term` wherever they occur: up to REMOVE they are generalised to [TERM],
from there on removed.

Candidates are first counted in the documents that hold entities; that count is at most df(t), so what is too frequent there is dropped before
the whole corpus is counted, and only words that a filter of the rest may hold are.

Defined results: a null text is empty; repeated rows get the same spans and count as documents each; a null doc_id is an id; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm.common import BitFilter, id_of, join_by_key, lower_ascii, materialise, text_of
from chronofact.llm.spans import BLANKS, Kind, find, listed, replaced, summary

BASE = 4
WINDOW = 5
PSEUDO = 1.0
LIKELY = 0.4
GENERALISE = 0.85
REMOVE = 0.95
KEYS = ["__id", "__th"]
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_BLANK = r"[\x20\x09-\x0D]"
#: What a term sheds at both ends.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…¿¡–—"
_BARE = r"[^\x20\x09-\x0D" + "".join(f"\\{c}" for c in _MARKS) + "]"
_TERM = rf"{_BARE}(?:[^\x20\x09-\x0D]*{_BARE})?"


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def kinds() -> list[Kind]:
    """The base kinds, as listed. Possessive forms of the same patterns, with a match never begun inside a run that has failed: long runs cost no backtracking."""
    m, t = F.col("__m"), F.col("__t")
    digits = F.regexp_replace(m, "[^0-9]", "")
    return [
        Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", F.lit(True), t.contains("@")),
        Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), t.rlike(r"[0-9]\.[0-9]")),
        Kind("card", r"[0-9](?:[\x20-]?[0-9])++", F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False), t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", F.length(digits).between(9, 15), t.rlike(r"\+[0-9]")),
    ]


def _term(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(_MARKS)))


def _is_term(term: Column) -> Column:
    """Words that may disclose: three characters or more, not themselves of the form of an entity."""
    return (F.length(term) >= 3) & ~term.rlike(r"@|[0-9][^0-9]*[0-9][^0-9]*[0-9]")


def _terms(text: Column) -> Column:
    """A text's different words, lower-cased and without the marks around them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t")).withColumn("__th", F.xxhash64("__t"))


def hinted(rows: DataFrame) -> DataFrame:
    """The rows that may hold entities."""
    hints = kinds()[0].hint
    for kind in kinds()[1:]:
        hints = hints | kind.hint
    return rows.filter(hints)


def entities(rows: DataFrame) -> DataFrame:
    """The base spans, once for rows repeated in id and text, with the words before and after."""
    return materialise(find(hinted(rows).select(*KEYS, "__t"), KEYS, "__t", kinds(), WINDOW))


def _occurrences(rows: DataFrame, wanted: BitFilter) -> DataFrame:
    """KEYS and __h, once a row: the terms that the filter may hold."""
    words = rows.select(*KEYS, F.explode(_terms(F.col("__t"))).alias("__w")).filter(_is_term(F.col("__w"))).select(*KEYS, F.xxhash64("__w").alias("__h"))
    return wanted.mark(words, F.col("__h"), "__maybe").filter("__maybe").drop("__maybe")


def disclosing_terms(rows: DataFrame, found: DataFrame, least: float = GENERALISE, likely: float = LIKELY, pseudo: float = PSEUDO) -> tuple[DataFrame, DataFrame]:
    """(__h, ratio, __dft): hashes of the terms that disclose some entity, how strongly, and in how many rows they stand; and the candidates' occurrences."""
    value = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))
    protected = F.array(F.xxhash64("kind", value), F.xxhash64("kind"))
    near = found.select(*KEYS, F.explode(protected).alias("__e"), F.concat("before", "after").alias("__near"))
    pairs = near.select(*KEYS, "__e", F.explode("__near").alias("__w")).withColumn("__w", _term(F.col("__w"))).filter(_is_term(F.col("__w")))
    # Rows repeated in id and text count each.
    times = materialise(rows.join(found.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__times")))
    joint = pairs.select(*KEYS, "__e", F.xxhash64("__w").alias("__h")).distinct().join(times, KEYS).groupBy("__e", "__h").agg(F.sum("__times").alias("__both"))
    own = near.select(*KEYS, "__e").distinct().join(times, KEYS).groupBy("__e").agg(F.sum("__times").alias("__dfe"))
    total = float(max(rows.count(), 2))
    share = F.col("__dfe") / total
    chance = lambda dft: (F.col("__both") + pseudo * share) / (F.col(dft) + pseudo)
    joint = materialise(joint.join(own, "__e"))
    count = lambda df, out: df.groupBy("__h").agg(F.count(F.lit(1)).alias(out))
    local = count(_occurrences(hinted(rows), BitFilter.of(joint, F.col("__h"), joint.count())), "__local")
    few = materialise(joint.join(local, "__h").filter(chance("__local") >= likely).drop("__local"))
    held = materialise(_occurrences(rows, BitFilter.of(few, F.col("__h"), few.count())))
    seen = count(held, "__dft")
    information = -F.log(share)
    ratio = F.when(information > 1e-9, F.log(chance("__dft") / share) / information).otherwise(0.0)
    scored = few.join(seen, "__h").filter(chance("__dft") >= likely)
    return materialise(scored.groupBy("__h").agg(F.max(ratio).alias("ratio"), F.first("__dft").alias("__dft")).filter(F.col("ratio") >= least)), held


def term_spans(rows: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """KEYS, kind, rank, start, end, ratio of every occurrence of the terms. Only the texts that hold some are cut into words."""
    filter_, total = BitFilter.of(terms, F.col("__h"), terms.count()), terms.agg(F.coalesce(F.sum("__dft"), F.lit(0))).first()[0]
    met = lambda df, spread: join_by_key(df, terms, ["__h"], "__dft", total, spread).filter("ratio IS NOT NULL")
    with_terms = materialise(met(held, F.struct(*KEYS)).select(*KEYS).distinct())
    doc = F.xxhash64(*KEYS)
    texts = BitFilter.of(with_terms, doc, with_terms.count()).mark(rows, doc, "__maybe").filter("__maybe")
    texts = texts.join(with_terms, KEYS, "left_semi").select(*KEYS, "__t").dropDuplicates(KEYS)
    # Words and the blanks between them, in turn.
    parts = texts.select(*KEYS, F.posexplode(F.split("__t", rf"(?<={_BLANK})(?!{_BLANK})|(?<!{_BLANK})(?={_BLANK})")).alias("__i", "__w"))
    parts = parts.withColumn("__to", F.sum(F.length("__w")).over(W.partitionBy(*KEYS).orderBy("__i").rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = parts.withColumn("__term", _term(F.col("__w"))).filter(_is_term(F.col("__term")))
    start = F.col("__to") - F.length(F.ltrim("__w", F.lit(_MARKS)))
    parts = parts.select(*KEYS, F.xxhash64("__term").alias("__h"), start.alias("start"), (start + F.length("__term")).alias("end"))
    parts = met(filter_.mark(parts, F.col("__h"), "__maybe").filter("__maybe").drop("__maybe"), F.struct(*KEYS, "start"))
    return parts.select(*KEYS, F.lit("term").alias("kind"), F.lit(BASE).alias("rank"), "start", "end", "ratio")


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, **options: float) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, KEYS, __t), and their spans: KEYS, kind, rank, start, end, ratio (null for base spans)."""
    rows = _rows(docs, id_col, text_col)
    found = entities(rows)
    terms, held = disclosing_terms(rows, found, generalise, **options)
    spans = found.select(*KEYS, "kind", "rank", "start", "end", F.lit(None).cast("double").alias("ratio"))
    if terms.take(1):
        spans = spans.unionByName(term_spans(rows, terms, held))
    return rows, spans


def scan(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows, spans = all_spans(docs, **options)
    found = rows.select("doc_id", *KEYS).join(summary(spans, KEYS, BASE), KEYS, "left")
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string>>)")
    found = found.select("doc_id", F.coalesce("all", none).alias("all"), F.coalesce("base", none).alias("base"))
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select("doc_id", *[count(k.name) for k in kinds()], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame, remove: float = REMOVE, **options: object) -> DataFrame:
    """doc_id, text: base spans as [KIND], disclosing terms as [TERM] or removed."""
    rows, spans = all_spans(docs, **options)
    by = F.when(F.col("rank") < BASE, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("ratio") >= remove, F.lit("")).otherwise(F.lit("[TERM]"))
    return replaced(rows, KEYS, "__t", spans.select(*KEYS, "start", "end", by.alias("by")), "text").select("doc_id", "text")
