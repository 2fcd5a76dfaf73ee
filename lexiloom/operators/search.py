"""Search over symbols and documents: substring ranking, BM25 over code tokens, phrases and a typo-tolerant fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.durable import materialize
from lexiloom.functions import code_tokens, fuzzy_match, kind_priority
from lexiloom.schemas import KIND_ALIASES

K1, B = 1.2, 0.75


def query_tokens(query: str) -> list[list[str]]:
    """The tokens of each word of a query: the same rules as functions.code_tokens, on the driver."""
    out = []
    for word in query.split():
        parts, now = [], ""
        for i, c in enumerate(word):
            if not c.isalnum():
                parts, now = [*parts, now], ""
                continue
            if now and c.isupper() and (not word[i - 1].isupper() or (i + 1 < len(word) and word[i + 1].islower())):
                parts, now = [*parts, now], ""
            now += c.lower() if c.isascii() else c
        tokens = [t for t in [*parts, now] if len(t.encode()) >= 2]
        if tokens:
            out.append(tokens)
    return out


def kind_filter(df: DataFrame, kind: str | None) -> DataFrame:
    """Rows of a kind by any of its names; an unknown name filters nothing."""
    known = KIND_ALIASES.get(kind.lower()) if kind else None
    return df.where(F.col("kind") == known) if known else df


def path_filter(df: DataFrame, prefix: str | None) -> DataFrame:
    return df.where(F.col("file_path").startswith(prefix)) if prefix else df


def substring_search(symbols: DataFrame, query: str, limit: int = 20, offset: int = 0, kind: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols whose name, qualified name, signature or doc comment contains the query, ignoring case: exact names first, then by kind and name."""
    q = F.lit(query.lower())
    hit = F.lit(False)
    for c in ("name", "qualified_name", "signature", "doc_comment"):
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    found = path_filter(kind_filter(symbols.where(hit), kind), path)
    ranked = found.withColumn("exact", (F.lower("name") == q).cast("int")).withColumn("priority", kind_priority("kind"))
    page = ranked.orderBy(F.desc("exact"), "priority", "name", "id")
    return (page.offset(offset) if offset else page).limit(limit).select("id", "name", "kind", "file_path", "exact", "priority")


def tokenized(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, tokens, len): one row for each document and field that isn't null."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("body")) for f in fields])
    rows = docs.select(F.col(key).alias("id"), F.explode(each).alias("x")).where("x.body is not null")
    return rows.select("id", "x.field", code_tokens("x.body").alias("tokens")).withColumn("len", F.size("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(field, term, id, tf, len) for a stored index; write it by by_term, and a query reads its terms only. Terms are counted within their row, so nothing is held for a task's rows together."""
    own = tokens.select("id", "field", "len", F.sort_array("tokens").alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = own.where("size(t) > 0").select("id", "field", "len", "t", starts.alias("s"))
    each = runs.select("id", "field", "len", F.explode(F.transform("s", lambda p, k: F.struct(F.get("t", p).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("t")) - p).cast("long").alias("tf")))).alias("x"))
    return each.select("field", "x.term", "id", "len", "x.tf")


def by_term(stored: DataFrame) -> DataFrame:
    """Postings in the order in which to write them: ranges of terms, and of ids within a term that many documents have."""
    return stored.repartitionByRange("term", "id").sortWithinPartitions("term")


def token_stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, df, cf): documents, one in each row, with a term in any of the fields, and its occurrences; one exchange, combined before it."""
    tokens = F.concat(*[F.coalesce(code_tokens(F.col(f).cast("string")), F.array().cast("array<string>")) for f in fields])
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return docs.select(tokens.alias("tokens")).select(F.explode(F.concat(once, each)).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))


def lengths(tokens: DataFrame) -> DataFrame:
    """(id, field, len), the documents of a stored index beside its postings."""
    return tokens.select("id", "field", "len")


def _scores(hits: DataFrame, lens: DataFrame) -> DataFrame:
    stats = lens.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")  # a row for each field and word, and for each field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))


def _equals(word: str):
    return lambda t: t == word


def _counted(tokens: DataFrame, words: list[list[str]]) -> DataFrame:
    """(id, field, len, found): of each document the query's words that it has, with their number; a word of several tokens counts as a phrase of adjacent ones."""
    joined = F.concat(F.lit("  "), F.array_join("tokens", "  "), F.lit("  "))
    each = []
    for w in {" ".join(w): w for w in words}.values():
        term = "  ".join(w)
        n = F.size(F.filter("tokens", _equals(w[0]))) if len(w) == 1 else F.floor((F.length(joined) - F.length(F.replace(joined, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("int")
        each.append(F.struct(F.lit(" ".join(w)).alias("term"), n.alias("tf")))
    return tokens.select("id", "field", "len", F.filter(F.array(*each), lambda x: x["tf"] > 0).alias("found"))


def _scored(tokens: DataFrame, words: list[list[str]]) -> DataFrame | None:
    """Scores of the documents with any of the words; None if there is none. Tokens are made once, for a table without them."""
    counted = materialize(_counted(tokens, words), "counted")
    hits = counted.select("id", "field", "len", F.explode("found").alias("x")).select("id", "field", "len", "x.*")
    return None if hits.isEmpty() else _scores(hits, counted)


def bm25_search(tokens: DataFrame, query: str, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """(id, score) of the best documents, by the sum over fields and words of Okapi BM25; ties by id.

    tokens: of tokenized(). Where no document has any of the words, words within one edit of a term's prefix
    count instead, each such term with a constant score of 1 (fuzzy).
    """
    words = query_tokens(query)
    found = _scored(tokens, words) if words else None
    if found is None:
        return fuzzy_search(tokens, query, limit) if fuzzy and words else tokens.select("id", F.lit(0.0).alias("score")).limit(0)
    return found.orderBy(F.desc("score"), "id").limit(limit)


def bm25_lookup(stored: DataFrame, lens: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score) as by bm25_search, of single words, from stored postings and lengths: only the words' postings are read."""
    words = sorted({w[0] for w in query_tokens(query) if len(w) == 1})
    hits = stored.where(F.col("term").isin(words))
    return _scores(hits, lens).orderBy(F.desc("score"), "id").limit(limit)


def fuzzy_search(tokens: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score): documents with terms that match a word of the query by fuzzy_match; the score is the number of such terms."""
    hit = F.lit(False)
    term = F.col("term")
    for w in query_tokens(query):
        for t in w:
            hit = hit | fuzzy_match(term, t)
    terms = tokens.select("id", F.explode(F.array_distinct("tokens")).alias("term")).where(hit).distinct()
    return terms.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase_search(tokens: DataFrame, words: list[str]) -> DataFrame:
    """(id, field): documents in which the words stand next to each other."""
    text = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    return tokens.where(F.contains(text, F.lit(" " + " ".join(words) + " "))).select("id", "field")


def search(symbols: DataFrame, query: str, limit: int = 20, offset: int = 0, kind: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols ranked by BM25 over name, qualified name, signature and doc comment, filters first; if none match, those of substring_search with score 0."""
    kept = path_filter(kind_filter(symbols, kind), path)
    scores = materialize(bm25_search(tokenized(kept, "id", ["name", "qualified_name", "signature", "doc_comment"]), query, limit + offset), "found")
    if scores.isEmpty():
        scores = substring_search(kept, query, limit + offset).select("id", F.lit(0.0).alias("score"))
    page = symbols.join(scores, "id").orderBy(F.desc("score"), kind_priority("kind"), "name", "id")
    return (page.offset(offset) if offset else page).limit(limit).select("id", "name", "kind", "file_path", "signature", "score")
