"""Information-theoretic sanitisation of personal data, in SQL expressions.

Base patterns give the protected entities. For each term in the documents of an entity, document
counts over the whole corpus estimate how much the term tells of it: the pointwise mutual
information of term and entity, as a share of the entity's own information content. Terms that
tell more than the threshold, with a minimum of support, become spans of kind `term` wherever they
stand, in whatever document, and the sanitised text has them removed, as it has entities
generalised to their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, documents, plain_text, wrapped

#: Kinds in the order of ties. Runs are possessive and start where the leftmost match must start, so time stays linear on hostile texts; matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be sought in it.
GATES = {"email": "contains(text, '@')", "ip": r"text RLIKE r'[0-9]\.[0-9]+\.[0-9]+\.[0-9]'", "card": r"text RLIKE r'[0-9](?:[\x20-]?[0-9]){11}'", "phone": r"contains(text, '+') AND text RLIKE r'\+[0-9]'"}
KINDS = [*PATTERNS, "term"]
WORD = r"\p{L}+"
KEY = ["doc_id", "h", "n"]
#: Up to so many told terms are broadcast; more are joined by a shuffle.
SENT = 500_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    place = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(place, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """The tests beyond the patterns: parts of an address, digits and checksum of a card, digits of a phone number."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    ip = found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    card = F.length(digits).between(12, 19) & luhn(F.substring(digits, 1, 19))
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text"))


def _meet(a: DataFrame, b: DataFrame, how: str = "inner", more: Column | None = None) -> DataFrame:
    """a joined with the rows of b of the same document, a null id too; b's other columns must have names of their own."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return a.join(b, same if more is None else same & more, how).drop(*[f"_{c}" for c in KEY])


def base_matches(rows: DataFrame) -> DataFrame:
    """(doc_id, h, n, kind, start, end, found) of every base span of distinct rows.

    A text is cut at its matches: the lengths of the pieces between them, added up with the
    matches' own, give the offsets in code points.
    """
    parts = None
    for kind, pattern in PATTERNS.items():
        found = rows.filter(GATES[kind]).select("doc_id", "h", "n", F.regexp_extract_all("text", F.lit(pattern), 0).alias("found"), F.split("text", pattern, -1).alias("gaps"))
        one = found.filter(F.size("found") > 0).select("doc_id", "h", "n", F.lit(kind).alias("kind"), F.posexplode(F.expr("transform(found, (x, i) -> named_struct('found', x, 'gap', length(gaps[i])))")).alias("nth", "m")).select("doc_id", "h", "n", "kind", "nth", "m.*")
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.dropDuplicates(["doc_id", "h", "n", "kind", "nth"])
    so_far = Window.partitionBy("doc_id", "h", "n", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(so_far)
    placed = parts.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("found"))
    return placed.filter(valid(F.col("kind"), F.col("found"))).select("doc_id", "h", "n", "kind", "start", "end", "found")


def terms_of(text: Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), F.lower))


def disclosing_terms(rows: DataFrame, matches: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of the pairs over the threshold.

    With n documents, disclosure = ln(n · n(term, entity) / (n(term) · n(entity))) / ln(n / n(entity)):
    1 if every document with the term has the entity. n(term) counts all documents of the corpus that have the
    word, n(term, entity) those that have both, the word outside of addresses. As n(term, entity) is n(entity) at
    most, entities of less than `support` documents and terms of too many for the threshold fall out before words meet entities.
    """
    held = matches.select(*KEY, F.lower("found").alias("entity")).distinct()
    total = rows.agg(F.count(F.lit(1)).alias("n_all"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support).crossJoin(F.broadcast(total)).filter("n_all > n_entity")  # total is one row
    least = threshold * F.ln(F.col("n_all") / F.col("n_entity")) - 1e-9
    entities = cut(held.join(entities.withColumn("most", F.col("n_all") * F.exp(-least)), "entity"), "entities")
    said = rows.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter(F.col("n_term") >= support)
    whose = entities.groupBy(*KEY).agg(F.max("most").alias("most"))
    texts = _meet(rows, whose)
    words = texts.select(*KEY, "most", F.explode(terms_of(F.regexp_replace("text", PATTERNS["email"], " "))).alias("term")).distinct()
    words = words.join(said, "term").filter("n_term <= most").drop("most")
    both = _meet(words, entities).filter("n_term <= most")
    pairs = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"), F.first("n_all").alias("n_all")).filter(F.col("n_pair") >= support)
    ratio = F.ln(F.col("n_all") * F.col("n_pair") / (F.col("n_term") * F.col("n_entity"))) / F.ln(F.col("n_all") / F.col("n_entity"))
    return pairs.select("entity", "term", ratio.alias("disclosure")).filter(F.col("disclosure") >= threshold)


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, h, n, start, end) of every word of every text that is one of terms (distinct, column term)."""
    has = rows.select(*KEY, F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term").groupBy(*KEY).agg(F.collect_set("term").alias("terms"))
    texts = _meet(rows, has)
    words = texts.select(*KEY, "terms", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.split("text", WORD, -1).alias("gaps"))
    placed = words.select(
        *KEY, "words", F.expr("transform(words, (x, i) -> length(gaps[i]) + length(x))").alias("sizes"), F.expr("filter(transform(words, (x, i) -> if(array_contains(terms, lower(x)), i, -1)), i -> i >= 0)").alias("at")
    )
    # the lengths from one such word's end to the next one's
    step = F.expr("transform(at, (w, k) -> named_struct('size', length(words[w]), 'step', aggregate(slice(sizes, if(k = 0, 1, at[k - 1] + 2), w - if(k = 0, -1, at[k - 1])), 0, (s, x) -> s + x)))")
    parts = placed.select(*KEY, F.posexplode(step).alias("nth", "m")).select(*KEY, "nth", "m.*").dropDuplicates([*KEY, "nth"])
    end = F.sum("step").over(Window.partitionBy(*KEY).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return parts.withColumn("end", end).select(*KEY, (F.col("end") - F.col("size")).alias("start"), "end")


def find_spans(docs: DataFrame, threshold: float = 0.75, support: int = 2) -> DataFrame:
    """(doc_id, h, n, spans) for the distinct rows that have any span: an array of (start, rank, kind, end), in that order. rank is the kind's place in KINDS."""
    rows = _key(documents(docs))
    matches = cut(base_matches(rows), "matches")
    told = cut(disclosing_terms(rows, matches, threshold, support).select("term").distinct(), "told")
    base = matches.select(*KEY, "kind", "start", "end")
    # few enough terms go to the tasks, so that the words of all texts needn't be dealt out
    found = term_spans(rows, F.broadcast(told) if told.count() <= SENT else told)
    # letters stand in no entity but an address
    mail = base.filter("kind = 'email'").select("doc_id", "h", "n", F.col("start").alias("s"), F.col("end").alias("e"))
    apart = _meet(found, mail, "left_anti", (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))).select(*KEY, F.lit("term").alias("kind"), "start", "end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return base.unionByName(apart).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))


def scan_pii(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Null texts count as empty: no spans, the digest of the empty string. Rows with a null id are
    scanned too; repeated rows give repeated results, and count once in the statistics. An empty
    table gives an empty result. Columns other than doc_id and text are ignored.
    """
    spans = find_spans(docs, **settings)
    rows = _key(documents(docs)).select("doc_id", "h", "n")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.n") == F.col("b.n")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    all_rows = rows.alias("a").join(spans.alias("b"), same, "left").select("a.doc_id", F.coalesce("b.spans", F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")).alias("spans"))
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return all_rows.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """docs with entities generalised to their kind (`[email]`) and disclosing terms removed (`[…]`) from text.

    Every row stays, repeated ones and those of null ids too; other columns, whatever their names, and null texts are as
    they were; an empty table gives an empty result.
    """
    text = plain_text(docs)
    spans = find_spans(docs, **settings).select(F.col("doc_id").alias("at_id"), F.col("h").alias("at_h"), F.col("n").alias("at_n"), "spans")
    rows = wrapped(docs, id=docs["doc_id"].cast("long"), h=F.xxhash64(text), n=F.length(text), text=text)
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("h") == F.col("at_h")) & (F.col("n") == F.col("at_n")), "left")
    rebuilt = F.expr("""
        concat(array_join(transform(spans, (x, i) -> concat(
            substring(text, 1 + if(i = 0, 0, array_max(transform(slice(spans, 1, i), y -> y.end))), greatest(0, x.start - if(i = 0, 0, array_max(transform(slice(spans, 1, i), y -> y.end))))),
            if(x.kind = 'term', '[…]', concat('[', x.kind, ']')))), ''),
          substring(text, 1 + array_max(transform(spans, y -> y.end))))
    """)
    return joined.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(F.col("row").withField("text", rebuilt)).alias("row")).select("row.*")
