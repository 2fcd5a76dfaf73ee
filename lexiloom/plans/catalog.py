"""Registered queries of the engine and the SQL they are compared with; every query reads its whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import functions as fn
from lexiloom.durable import materialize
from lexiloom.operators import changes, deps, export, search, symbols, workspace
from lexiloom.operators.callgraph import CallGraph, enriched
from lexiloom.plans import bindings as b
from lexiloom.schemas import KIND_ALIASES, KIND_PRIORITY, LANGUAGES
from lexiloom.streaming import watch

QUERIES: dict = {}
SQL: dict = {}

_SY, _CE, _IM = b.oracle(b.SYMBOLS), b.oracle(b.CALL_EDGES), b.oracle(b.IMPORTS)
TOKENS = b.sql_tokens
QUERY = "hested therea"
NAME = "the"


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def _symbols(spark, d):
    return b.bound(spark, d, b.SYMBOLS)


def _graph(spark, d):
    return CallGraph(b.call_edges(spark, d), distinct=True)


def _stored_graph(spark, d):
    return CallGraph.stored(b.call_edges(spark, d), distinct=True)


def _most_called(g: CallGraph) -> str:
    return g.most_called


_TOP = "(select callee from ce group by callee order by count(*) desc, callee limit 1)"


def _case(col: str, d: dict, default: str) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v!r}" for k, v in d.items()) + f" else {default} end"


_ID_REST = r"regexp_replace(i, '^\[[^\]]*\]', '')"


@query(rf"""
with sy as ({_SY}), x as (select id as i, qualified_name q from sy union all select '[alpha]' || id, qualified_name from sy), r as (select i, q, {_ID_REST} rest from x)
select i as id, regexp_extract(i, '^\[([^\]]*)\]', 1) as root, string_split(rest, '::')[1] as file, regexp_replace(regexp_replace(rest, '#[^#]*$', ''), '^.*?::', '') as name,
  case when contains(rest, '#') then string_split(rest, '#')[-1] else '' end as kind, string_split(q, '::')[-1] as short_name, string_split(q, '::')[1] as module from r
""")
def symbol_id_parts(spark, d):
    s = _symbols(spark, d)
    x = s.select(fn.symbol_id("file_path", "qualified_name", "kind").alias("id"), "qualified_name").union(s.select(fn.symbol_id("file_path", "qualified_name", "kind", F.lit("alpha")), "qualified_name"))
    return x.select("id", fn.id_root("id").alias("root"), fn.id_file("id").alias("file"), fn.id_name("id").alias("name"), fn.id_kind("id").alias("kind"), fn.short_name("qualified_name").alias("short_name"), fn.extract_module("qualified_name").alias("module"))


@query(f"with sy as ({_SY}) select file_path, {_case('string_split(file_path, chr(46))[-1]', LANGUAGES, 'string_split(file_path, chr(46))[-1]')} as language from sy")
def detect_language(spark, d):
    return _symbols(spark, d).select("file_path", fn.detect_language("file_path").alias("language"))


@query(f"with sy as ({_SY}), w as (select *, upper(case kind when 'function' then 'fn' when 'interface' then 'trait' when 'module' then 'mod' when 'field' then 'nothing' else kind end) word from sy) select word, {_case('lower(word)', KIND_ALIASES, 'null')} as kind, {_case('kind', KIND_PRIORITY, '7')} as priority from w")
def kind_alias(spark, d):
    word = F.upper(F.when(F.col("kind") == "function", "fn").when(F.col("kind") == "interface", "trait").when(F.col("kind") == "module", "mod").when(F.col("kind") == "field", "nothing").otherwise(F.col("kind")))
    return _symbols(spark, d).select(word.alias("word"), fn.kind_alias(word).alias("kind"), fn.kind_priority("kind").alias("priority"))


@query(rf"""with sy as ({_SY}) select file_path, replace(replace(regexp_replace(file_path, '\.[^./]*$', ''), '/', '::'), 'src::', '') as module, regexp_replace(file_path, '/[^/]*$', '') as dir, string_split(file_path, '/')[-1] as file,
  'L' || start_line || case when start_line = end_line then '' else '-' || end_line end as span, case when length(signature) > 20 then substring(signature, 1, 17) || '...' else signature end as cut, '[alpha]' || file_path as display from sy""")
def module_name(spark, d):
    return _symbols(spark, d).select("file_path", fn.module_name("file_path").alias("module"), fn.dir_of("file_path").alias("dir"), fn.file_name("file_path").alias("file"), fn.span_display("start_line", "end_line").alias("span"), fn.truncated("signature", 20, 17).alias("cut"), fn.file_display(F.lit("alpha"), "file_path").alias("display"))


@query("""select doc_id, substring(sha256(text), 1, 16) as hash, case when n_chars < 60 then n_chars || 's ago' when n_chars < 3600 then n_chars // 60 || 'm ago' when n_chars < 86400 then n_chars // 3600 || 'h ago' else n_chars // 86400 || 'd ago' end as age,
  case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', n_chars / 1024.0) else printf('%.1f MB', n_chars / 1048576.0) end as size,
  case when doc_id = 0 then 'unknown' else strftime(to_timestamp(doc_id * 86400) at time zone 'UTC', '%Y-%m-%d') end as day, substring(text, 1, 5) as head from documents""")
def text_functions(spark, d):
    return b.table(spark, d, "documents").select("doc_id", fn.content_hash("text").alias("hash"), fn.age_str("n_chars").alias("age"), fn.size_str("n_chars").alias("size"), fn.format_timestamp(F.col("doc_id") * 86400).alias("day"), fn.truncate_str("text", 5).alias("head"))


@query("with h as (select doc_id, substring(sha256(text), 1, 16) h, source from documents) select source, substring(sha256(string_agg(h, '' order by h)), 1, 16) as hash from h group by source")
def workspace_hash(spark, d):
    return b.table(spark, d, "documents").groupBy("source").agg(F.collect_list(fn.content_hash("text")).alias("h")).select("source", fn.workspace_hash("h").alias("hash"))


@query(f"select doc_id, unnest({TOKENS('text')}) as token from documents")
def code_tokens(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.explode(fn.code_tokens("text")).alias("token"))


@query(f"with t as (select doc_id, unnest({TOKENS('text')}) as term from documents) select term, count(distinct doc_id) as df, cast(count(*) as bigint) as cf from t group by term")
def token_stats(spark, d):
    return search.token_stats(b.table(spark, d, "documents"), ["text"])


def _fields(spark, d):
    return search.tokenized(b.table(spark, d, "documents"), "doc_id", ["source", "text"])


_DOC_TOKENS = f"toks as (select doc_id as id, 'source' as field, {TOKENS('source')} as tokens from documents union all select doc_id, 'text', {TOKENS('text')} from documents)"


def _bm25_sql(words: list[str]) -> str:
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""
with {_DOC_TOKENS}, st as (select field, count(*) n, avg(len(tokens)) al from toks group by field),
hits as (select id, field, len(tokens) len, term, len(list_filter(tokens, lambda v: v = term)) tf from (select *, unnest([{terms}]) term from toks)),
h as (select * from hits where tf > 0), df as (select field, term, count(*) df from h group by 1, 2)
select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6) as score from h join df using (field, term) join st using (field) group by id order by score desc, id limit 20
"""


@query(_bm25_sql(QUERY.split()))
def bm25_search(spark, d):
    return search.bm25_search(_fields(spark, d), QUERY)


@query(f"""with {_DOC_TOKENS} select id, field from toks where contains(' ' || array_to_string(tokens, ' ') || ' ', ' of the ')""")
def phrase_search(spark, d):
    return search.phrase_search(_fields(spark, d), ["of", "the"])


@query(f"""with {_DOC_TOKENS}, t as (select distinct id, unnest(tokens) term from toks)
select id, cast(count(*) as double) as score from t where (length(term) >= 6 and damerau_levenshtein(substring(term, 1, 6), 'hesetd') <= 1) or (length(term) >= 5 and damerau_levenshtein(substring(term, 1, 5), 'hesetd') <= 1) or (length(term) >= 7 and damerau_levenshtein(substring(term, 1, 7), 'hesetd') <= 1) group by id order by score desc, id limit 20""")
def fuzzy_search(spark, d):
    return search.fuzzy_search(_fields(spark, d), "hesetd")


_SUB = "(contains(lower(name), '{q}') or contains(lower(qualified_name), '{q}') or contains(lower(signature), '{q}') or contains(lower(doc_comment), '{q}'))"
_PRIO = _case("kind", KIND_PRIORITY, "7")


@query(f"with sy as ({_SY}) select id, name, kind, file_path, cast(lower(name) = 'widget' as int) as exact, {_PRIO} as priority from sy where {_SUB.format(q='widget')} order by exact desc, priority, name, id limit 20")
def substring_search(spark, d):
    return search.substring_search(_symbols(spark, d), "Widget")


@query(f"with sy as ({_SY}) select id, name, kind, file_path, cast(lower(name) = 'bolt' as int) as exact, {_PRIO} as priority from sy where {_SUB.format(q='bolt')} and kind = 'interface' and starts_with(file_path, 'src/') order by exact desc, priority, name, id limit 5 offset 3")
def search_kind_path_page(spark, d):
    return search.substring_search(_symbols(spark, d), "bolt", 5, 3, "trait", "src/")


_SYMBOL_FIELDS = " union all ".join(f"select id, '{f}' as field, {TOKENS(f)} as tokens from sy where {f} is not null" for f in ("name", "qualified_name", "signature", "doc_comment"))


@query(f"""with sy as ({_SY}), toks as ({_SYMBOL_FIELDS}), st as (select field, count(*) n, avg(len(tokens)) al from toks group by field),
hits as (select id, field, len(tokens) len, term, case term when 'small widget' then len(string_split('  ' || array_to_string(tokens, '  ') || '  ', ' small  widget ')) - 1 else len(list_filter(tokens, lambda v: v = term)) end tf from (select *, unnest(['small widget', 'steel']) term from toks)),
h as (select * from hits where tf > 0), df as (select field, term, count(*) df from h group by 1, 2),
sc as (select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6) as score from h join df using (field, term) join st using (field) group by id order by score desc, id limit 20)
select sy.id, name, kind, file_path, signature, score from sc join sy on sy.id = sc.id""")
def symbol_search(spark, d):
    return search.search(_symbols(spark, d), "smallWidget steel")


@query(f"""with sy as ({_SY}), toks as ({_SYMBOL_FIELDS}), st as (select field, count(*) n, avg(len(tokens)) al from toks group by field),
hits as (select id, field, len(tokens) len, term, len(list_filter(tokens, lambda v: v = term)) tf from (select *, unnest(['small', 'widget']) term from toks)),
h as (select * from hits where tf > 0), df as (select field, term, count(*) df from h group by 1, 2)
select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6) as score from h join df using (field, term) join st using (field) group by id order by score desc, id limit 20""")
def bm25_stored(spark, d):
    """From stored postings, sorted by term: the scan reads the words' row groups."""
    # symbols are few bytes each in a table's file, and many postings: one task shouldn't have all of a file
    tokens = materialize(search.tokenized(_symbols(spark, d).repartition("id"), "id", ["name", "qualified_name", "signature", "doc_comment"]), "tokens")
    stored = materialize(search.by_term(search.postings(tokens)), "postings")
    return search.bm25_lookup(stored, materialize(search.lengths(tokens), "lengths"), "small widget")


@query(f"with sy as ({_SY}) select id, name, kind, file_path, start_line, end_line from sy where id = (select min(id) from sy)")
def symbol_lookup(spark, d):
    s = _symbols(spark, d)
    return symbols.lookup(s, s.agg(F.min("id")).first()[0]).select("id", "name", "kind", "file_path", "start_line", "end_line")


@query(f"with sy as ({_SY}), m as (select max(name) m from sy) select id, name, qualified_name, kind, file_path, 2 as rank from sy, m where name = m order by id limit 1")
def find_symbol(spark, d):
    s = _symbols(spark, d)
    return symbols.find_symbol(s, s.agg(F.max("name")).first()[0])


@query(f"with sy as ({_SY}) select file_path, count(*) as n, list(name order by ordinal) as names from sy group by file_path")
def symbols_in_file(spark, d):
    return symbols.symbols_in_file(_symbols(spark, d))


@query(f"""with sy as ({_SY}) select p.file_path, p.qualified_name as symbol, c.qualified_name as child, case when c.id is not null then row_number() over (partition by p.id order by c.ordinal) = count(*) over (partition by p.id) end as is_last
from sy p left join sy c on c.parent = p.id where p.parent is null""")
def file_outline(spark, d):
    return symbols.file_outline(_symbols(spark, d))


@query(f"with sy as ({_SY}) select regexp_replace(file_path, '/[^/]*$', '') as dir, count(distinct file_path) as files, count(*) as symbols from sy group by 1 having len(string_split(dir, '/')) <= 3")
def project_outline(spark, d):
    return symbols.project_outline(_symbols(spark, d))


@query(f"""with sy as ({_SY}), r as (select file_path, name, row_number() over (partition by file_path order by ordinal) rn from sy where parent is null and kind in ('function', 'struct', 'class', 'interface', 'enum'))
select file_path, list(name order by rn) as names, string_split(file_path, '/')[-1] as file_name from r where rn <= 5 group by file_path""")
def top_names(spark, d):
    return symbols.top_names(_symbols(spark, d))


@query(f"with sy as ({_SY}) select {_case('string_split(file_path, chr(46))[-1]', LANGUAGES, 'string_split(file_path, chr(46))[-1]')} as language, count(*) as n from sy group by 1")
def stats_language(spark, d):
    return symbols.stats_language(_symbols(spark, d))


@query(f"with sy as ({_SY}) select kind, count(*) as n from sy group by kind")
def stats_kind(spark, d):
    return symbols.stats_kind(_symbols(spark, d))


@query(f"with sy as ({_SY}) select count(distinct file_path) as total_files, count(*) as total_symbols from sy")
def stats_totals(spark, d):
    return symbols.stats_totals(_symbols(spark, d))


@query(f"with sy as ({_SY}), f as (select file_path, sum(length(signature)) as bytes from sy group by 1) select {_case('string_split(file_path, chr(46))[-1]', LANGUAGES, 'string_split(file_path, chr(46))[-1]')} as language, count(*) as files, cast(sum(bytes) as bigint) as bytes from f group by 1")
def files_per_language(spark, d):
    return symbols.files_per_language(_symbols(spark, d).groupBy("file_path").agg(F.sum(F.length("signature")).alias("bytes")))


_ID = b.IDENTIFIERS_SQL


@query(f"with ids as ({_ID}) select file_path, line, context, ref_kind from ids where name = '{NAME}' and ref_kind <> 'Definition' order by file_path, line, ref_kind, context limit 50 offset 10")
def refs(spark, d):
    return symbols.refs(b.identifiers(spark, d), NAME, offset=10)


@query(f"with ids as ({_ID}) select file_path, line, context, ref_kind from ids where name = '{NAME}' and ref_kind = 'Call' and starts_with(file_path, 'src1/') order by file_path, line, ref_kind, context limit 50")
def refs_kind_scope(spark, d):
    return symbols.refs(b.identifiers(spark, d), NAME, "call", "src1/")


@query(f"""with ids as ({_ID}) select name, count(*) filter (ref_kind in ('Call', 'Constructor')) as calls, count(*) filter (ref_kind = 'TypeRef') as types, count(*) filter (ref_kind = 'Import') as imports,
  count(*) filter (ref_kind not in ('Call', 'Constructor', 'TypeRef', 'Import')) as other, count(*) as total from ids where ref_kind <> 'Definition' group by name""")
def refs_breakdown(spark, d):
    return symbols.refs_breakdown(b.identifiers(spark, d))


@query(f"with ids as ({_ID}) select name, list(distinct file_path order by file_path) as files from ids group by name")
def identifier_index(spark, d):
    return symbols.identifier_index(b.identifier_files(spark, d))


@query(f"with im as ({_IM}) select imported as name, list(file_path order by file_path) as files from im group by imported")
def import_names(spark, d):
    return symbols.import_names(b.imports(spark, d).withColumn("names", F.array("imported")))


@query(r"select page_id, unnest(range(0, len(s))) as nth, unnest(s) as block from (select page_id, regexp_extract_all(html, '(?s)<script(?:\s[^>]*)?>(.*?)</script>', 1) s from pages)")
def script_blocks(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.posexplode(fn.script_blocks("html")).alias("nth", "block")).withColumn("nth", F.col("nth").cast("long"))


@query(r"""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages""")
def href_imports(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query(f"with ce as ({_CE}) select caller, callee from ce")
def graph_edges(spark, d):
    return _graph(spark, d).edges


@query(f"with ce as ({_CE}) select name, string_split(name, '::')[-1] as short_name from (select caller as name from ce union select callee from ce)")
def graph_nodes(spark, d):
    return _graph(spark, d).nodes


@query(f"with ce as ({_CE}) select string_split(name, '::')[-1] as short_name, list(name order by name) as names from (select caller as name from ce union select callee from ce) group by 1")
def short_names(spark, d):
    return _graph(spark, d).short_names()


@query(f"with ce as ({_CE}) select (select count(*) from ce) as edges, count(*) as nodes from (select caller from ce union select callee from ce)")
def graph_size(spark, d):
    g = _graph(spark, d)
    return g.edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(g.nodes.agg(F.count(F.lit(1)).alias("nodes")))


@query(f"with ce as ({_CE}) select caller as name from ce where callee = {_TOP}")
def callers(spark, d):
    g = _stored_graph(spark, d)
    return g.callers(_most_called(g))


@query(f"with ce as ({_CE}) select callee as name from ce where caller = {_TOP}")
def callees(spark, d):
    g = _stored_graph(spark, d)
    return g.callees(_most_called(g))


@query(f"with ce as ({_CE}) select distinct caller as name from ce where contains(callee, 'red_')")
def callers_partial(spark, d):
    return _graph(spark, d).callers("red_")


@query(f"with ce as ({_CE}), sy as ({_SY}) select c.caller as name, kind, file_path, start_line from ce c left join sy on sy.qualified_name = c.caller where callee = {_TOP}")
def callers_enriched(spark, d):
    g = _stored_graph(spark, d)
    return enriched(g.callers(_most_called(g)), _symbols(spark, d))


_TOP_T = _TOP[1:-1].replace("select callee", "select callee as t", 1)


def _walk(at: str, to: str) -> str:
    return f"with recursive ce as materialized ({_CE}), top as materialized ({_TOP_T}), w(name, depth) as (select {to}, 1 from ce, top where {at} = t union select {to}, depth + 1 from w join ce on w.name = ce.{at} where depth < 3)"


_UP, _DOWN = _walk("callee", "caller"), _walk("caller", "callee")


@query(f"{_UP} select name, cast(min(depth) as int) as depth from w, top where name <> t group by name")
def transitive_callers(spark, d):
    g = _stored_graph(spark, d)
    return g.transitive(_most_called(g))


@query(f"{_DOWN} select name, cast(min(depth) as int) as depth from w, top where name <> t group by name")
def transitive_callees(spark, d):
    g = _stored_graph(spark, d)
    return g.transitive(_most_called(g), 3, "callees")


@query(f"{_UP} select distinct string_split(name, '::')[1] as module from (select name from w, top where name <> t union select caller from ce, top where callee = t)")
def affected_modules(spark, d):
    g = _stored_graph(spark, d)
    return g.affected_modules(_most_called(g))


@query(
    f"""{_UP}, d(name, depth) as (select callee, 1 from ce, top where caller = t union select callee, depth + 1 from d join ce on d.name = ce.caller where depth < 3),
r(name) as (select callee from ce, top where caller = t union select callee from r join ce on r.name = ce.caller),
up as (select name, min(depth) depth from w, top where name <> t group by name), dn as (select distinct name from d, top where name <> t),
a as (select (select count(*) from ce, top where callee = t) as direct_callers, (select count(*) from ce, top where caller = t) as direct_callees, (select count(*) from up) as transitive_callers, (select cast(coalesce(max(depth), 0) as int) from up) as depth_reached,
  (select count(*) from dn) as transitive_callees, (select count(distinct string_split(name, '::')[1]) from (select name from up union select caller from ce, top where callee = t)) as modules)
select t as target, a.*, t in (select name from r) as in_cycle, direct_callers + transitive_callers as total_dependents,
  round(least(1.0, (ln(greatest(transitive_callers, direct_callers) + 1.0) / 6 + depth_reached / 3.0::double + ln(modules + 1.0) / 5) / 3), 6) as risk from a, top"""
)
def impact(spark, d):
    g = _stored_graph(spark, d)
    return g.impact(_most_called(g))


@query(f"with recursive ce as materialized ({_CE}), top as ({_TOP_T}), r(name) as (select callee from ce, top where caller = t union select callee from r join ce on r.name = ce.caller) select t as target, t in (select name from r) as in_cycle from top")
def call_cycle(spark, d):
    g = _stored_graph(spark, d)
    t = _most_called(g)
    return spark.createDataFrame([(t, g.has_cycle(t))], "target string, in_cycle boolean")


@query(f"""with recursive ce as materialized ({_CE}), e as materialized (select caller u, callee v from ce union select callee, caller from ce), a as (select min(u) a, max(u) z from e), r(name, hops) as (select a, 0 from a union select v, hops + 1 from r join e on r.name = e.u where hops < 6 and r.name <> (select z from a))
select cast(min(hops) as int) as hops from r where name = (select z from a)""")
def path_hops(spark, d):
    g = _stored_graph(spark, d)
    a, z = g.nodes.agg(F.min("name"), F.max("name")).first()
    return g.path(a, z).select("hops")


def _deps(spark, d):
    return deps.deps_edges(materialize(b.file_imports(spark, d), "imports"), _symbols(spark, d).select("file_path"))


def _stored_deps(spark, d):
    return materialize(_deps(spark, d), "deps")


_DEPS = f"""im as ({_IM}), kf as (select distinct file_path k from ({_SY})), mp as (select distinct module_path m from im),
cand as (select m, 1 tier, 0 pos, m p from mp union all select m, 2, 1, replace(regexp_replace(m, '^crate::', 'src/'), '::', '/') || '.rs' from mp where starts_with(m, 'crate::')
  union all select m, 2, 2, replace(regexp_replace(m, '^crate::', 'src/'), '::', '/') || '/mod.rs' from mp where starts_with(m, 'crate::')
  union all select m, 3, i, replace(m, '.', '/') || e from mp, (values (1, '.py'), (2, '/__init__.py'), (3, '.kt')) v(i, e) where contains(m, '.') and not contains(m, '/') and not contains(m, '::')
  union all select m, 4, i, regexp_replace(m, '^(\\./)+', '') || e from mp, (values (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '/index.ts')) v(i, e) where starts_with(m, './') or starts_with(m, '../')
  union all select m, 5, 0, min(k) from mp join kf on string_split(m, '::')[-1] = regexp_replace(string_split(k, '/')[-1], '\\.[^.]*$', '') group by m),
best as (select m, arg_min(p, tier * 10 + pos) dst from cand join kf on p = k group by m),
de as materialized (select distinct file_path as src_file, dst as dst_file from im join best on m = module_path where file_path <> dst)"""


@query(f"with {_DEPS} select src_file, dst_file from de")
def deps_edges(spark, d):
    return _deps(spark, d)


_FIRST = "(select min(src_file) from de)"


@query(f"with {_DEPS} select src_file as file from de where dst_file = {_FIRST}")
def deps_dependents(spark, d):
    e = _stored_deps(spark, d)
    return deps.dependents(e, e.agg(F.min("src_file")).first()[0])


@query(f"with {_DEPS} select dst_file as file from de where src_file = {_FIRST}")
def deps_dependencies(spark, d):
    e = _stored_deps(spark, d)
    return deps.dependencies(e, e.agg(F.min("src_file")).first()[0])


_MOD = r"replace(replace(regexp_replace({x}, '\.[^./]*$', ''), '/', '::'), 'src::', '')"


@query(f"with {_DEPS} select distinct {_MOD.format(x='f')} as module from (select src_file f from de union select dst_file from de)")
def deps_modules(spark, d):
    return deps.modules(_deps(spark, d))


@query(f"with recursive {_DEPS}, r(x, y) as (select src_file, dst_file from de union select x, dst_file from r join de on y = src_file) select x as file from r where x = y")
def deps_cycle_members(spark, d):
    return deps.cycle_members(_deps(spark, d))


@query(f"with {_DEPS} select 'graph TD' || chr(10) || string_agg(line, chr(10) order by line) as text from (select '    ' || {_MOD.format(x='src_file')} || ' --> ' || {_MOD.format(x='dst_file')} as line from de)")
def deps_mermaid(spark, d):
    return deps.mermaid_text(_deps(spark, d))


_CHANGES = f"""sy as ({_SY}), ns as ({b.oracle(b.NAME_STATUS)}), hk as ({b.oracle(b.HUNKS)}),
ok as (select * from ns where string_split(file, '.')[-1] in ({", ".join(repr(x) for x in changes.SUPPORTED)})),
ev as (select file, qualified_name as name, kind, start_line, end_line, 'Added' as change from sy join ok on file = file_path and status = 'A'
  union all select ok.file, qualified_name, kind, start_line, end_line, 'Modified' from sy join ok on file = file_path and status = 'M' where exists (select 1 from hk where hk.file = ok.file and hk.start <= end_line and start_line <= hk."end")
  union all select file, '[entire file deleted]', 'module', 0, 0, 'Deleted' from ok where status = 'D')"""


def _changes(spark, d):
    return changes.changed_symbols(b.bound(spark, d, b.NAME_STATUS), b.bound(spark, d, b.HUNKS), _symbols(spark, d))


@query(f"with {_CHANGES} select * from ev")
def changed_symbols(spark, d):
    return _changes(spark, d)


@query(f"with {_CHANGES} select change, count(*) as n from ev group by change")
def diff_counts(spark, d):
    return changes.diff_counts(_changes(spark, d))


@query(f"with {_CHANGES} select file, count(*) as n, list(change || ' ' || name order by start_line, name, change) as names from ev group by file")
def diff_by_file(spark, d):
    return changes.by_file(_changes(spark, d))


@query("select doc_id, cast(10 + doc_id % 50 as int) as start, cast(10 + doc_id % 50 + greatest(doc_id % 4 - 1, 0) as int) as stop from documents")
def diff_ranges(spark, d):
    lines = b.table(spark, d, "documents").select("doc_id", F.concat(F.lit("@@ -1,2 +"), 10 + F.col("doc_id") % 50, F.lit(","), F.col("doc_id") % 4, F.lit(" @@ fn")).alias("line"))
    return lines.select("doc_id", fn.diff_range("line").alias("r")).select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("stop"))


_BLAME = """ev as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) n, first_value(event_id) over (partition by user_id, event_type order by event_id) f from events),
bl as (select 'user' || user_id as file, cast(n as int) as line, rpad(event_type, 20, '0') || user_id as commit, event_type as author, f * 1000 as timestamp, case when f = 0 then 'unknown' else strftime(to_timestamp(f * 1000) at time zone 'UTC', '%Y-%m-%d') end as date, 'first ' || event_type as summary, event_id || ' ' || event_type as content from ev)"""


@query(f"with {_BLAME} select * from bl")
def blame_fill(spark, d):
    return changes.blame_lines(b.bound(spark, d, b.BLAME))


@query(f"with {_BLAME} select file, commit, author, max(timestamp) as timestamp, count(*) as lines from bl group by all")
def blame_commits(spark, d):
    return changes.blame_commits(changes.blame_lines(b.bound(spark, d, b.BLAME)))


def _manifests(spark, d):
    docs = b.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file_path"), "doc_id", "text")
    old = docs.where("doc_id % 11 <> 0").select("file_path", F.col("doc_id").alias("mtime_ns"), fn.content_hash("text").alias("hash"))
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    now = docs.where("doc_id % 13 <> 0").select("file_path", (F.col("doc_id") + (F.col("doc_id") % 3).cast("int") % 2).alias("mtime_ns"), fn.content_hash(body).alias("hash"))
    return now, old


@query("""with o as (select doc_id k from documents where doc_id % 11 <> 0), n as (select doc_id k, doc_id % 3 = 1 touched, doc_id % 7 = 0 changed from documents where doc_id % 13 <> 0)
select 'doc/' || coalesce(n.k, o.k) as file_path, case when n.k is null then 'removed' when o.k is not null and not touched then 'skip_mtime' when o.k is not null and not changed then 'skip_hash' else 'parse' end as action from n full join o on n.k = o.k""")
def incremental_plan(spark, d):
    return changes.incremental_plan(*_manifests(spark, d))


@query("""with o as (select doc_id k from documents where doc_id % 11 <> 0), n as (select doc_id k, doc_id % 3 = 1 touched, doc_id % 7 = 0 changed from documents where doc_id % 13 <> 0),
p as (select case when o.k is not null and not touched then 's' when o.k is not null and not changed then 's' else 'p' end a from n left join o on n.k = o.k)
select count(*) as scanned, count(*) filter (a = 'p') as parsed, count(*) filter (a = 's') as skipped, 0::bigint as truncated, 0::bigint as failed, 0::bigint as degraded from p""")
def index_counters(spark, d):
    plan = changes.incremental_plan(*_manifests(spark, d)).where("action <> 'removed'")
    status = plan.select("file_path", F.when(F.col("action") == "parse", "parsed").otherwise(F.col("action")).alias("status"), F.lit(None).cast("string").alias("reason"))
    return symbols.index_counters(status).drop("failures")


def _workspace(spark, d):
    s = _symbols(spark, d)
    return workspace.union_all([workspace.prefixed_symbols(s.where(F.col("ordinal") % 2 == k), label, f"id{k}") for label, k in b.ROOTS.items()])


_WS = f"sy as ({_SY}), ws as (select case when ordinal % 2 = 0 then '[alpha]' else '[beta]' end l, * from sy)"


@query(f"with {_WS} select l || id as id, name, l || qualified_name as qualified_name, l || parent as parent, file_path, 'id' || cast(ordinal % 2 as int) as root_id from ws")
def workspace_union(spark, d):
    return _workspace(spark, d).select("id", "name", "qualified_name", "parent", "file_path", "root_id")


@query(f"with {_WS}, w as (select l || id as id, name, kind, file_path, l || qualified_name as qualified_name, signature, doc_comment from ws) select id, name, kind, file_path, cast(lower(name) = 'alpha' as int) as exact, {_PRIO} as priority from w where {_SUB.format(q='alpha')} order by exact desc, priority, name, id limit 20")
def workspace_search(spark, d):
    return search.substring_search(_workspace(spark, d), "alpha")


@query(f"with {_WS} select file_path, name, label from (select file_path, name, case when ordinal % 2 = 0 then 'alpha' else 'beta' end as label from ws) where label = 'alpha' and file_path = (select min(file_path) from ws)")
def file_by_display(spark, d):
    s = _symbols(spark, d).select("file_path", "name", F.when(F.col("ordinal") % 2 == 0, "alpha").otherwise("beta").alias("label"))
    return workspace.file_key(s, "[alpha]" + s.agg(F.min("file_path")).first()[0])


@query(f"with sy as ({_SY}) select id, case when length(regexp_replace(file_path, '/[^/]*$', '')) % 2 = 0 then regexp_replace(file_path, '/[^/]*$', '') else 'src' end as root_path from sy")
def symbol_git_roots(spark, d):
    s = _symbols(spark, d)
    roots = s.select(F.explode(F.array(F.lit("src"), fn.dir_of("file_path"))).alias("root_path")).distinct().where("root_path = 'src' or length(root_path) % 2 = 0")
    return workspace.git_roots(s, roots)


@query("select source, substring(sha256('/data/' || source), 1, 8) as root_id, source as label from (select distinct source from documents)")
def root_ids(spark, d):
    path = F.concat(F.lit("/data/"), F.col("source"))
    return b.table(spark, d, "documents").select("source").distinct().select("source", fn.root_id(path).alias("root_id"), fn.root_label(path).alias("label"))


@query(f"with sy as ({_SY}), l as (select {_case('string_split(file_path, chr(46))[-1]', LANGUAGES, 'string_split(file_path, chr(46))[-1]')} as k, count(*) n from sy group by 1), d as (select kind k, count(*) n from sy group by 1) select 'language' as map, k as key, n from l union all select 'kind', k, n from d")
def count_maps(spark, d):
    m = symbols.count_maps(_symbols(spark, d))
    return m.select(F.lit("language").alias("map"), F.explode("by_language").alias("key", "n")).union(m.select(F.lit("kind"), F.explode("by_kind")))


@query(f"with {_WS} select l || id as id, 'id1' as root_id from ws where ordinal % 2 = 1")
def remove_root(spark, d):
    return workspace.remove_root(_workspace(spark, d), "id0").select("id", "root_id")


@query("""with e as (select event_type, epoch_us(ts) // 1000 ms, user_id from events), g as (select *, case when ms - lag(ms) over (partition by event_type order by ms) < 600000 then 0 else 1 end n from e),
s as (select *, sum(n) over (partition by event_type order by ms rows unbounded preceding) k from g) select event_type, min(ms) as first_ms, max(ms) as last_ms, count(*) as events, count(distinct user_id) as files from s group by event_type, k""")
def debounce_sessions(spark, d):
    e = b.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    # whole milliseconds, as the gap is given in them
    e = e.withColumn("ms", F.unix_millis("ts")).withColumn("ts", F.timestamp_millis("ms"))
    return watch.debounced(e, "ts", "user_id", "10 minutes", ["event_type"], watermark=None, paths=False)


@query("""with e as (select event_type, epoch_us(ts) // 1000 ms from events), g as (select *, case when ms - lag(ms) over (partition by event_type order by ms) < 600000 then 0 else 1 end n from e),
s as (select *, sum(n) over (partition by event_type order by ms rows unbounded preceding) k from g) select event_type, min(ms) as first_ms, max(ms) as last_ms, count(*) as events from s group by event_type, k""")
def watch_stream(spark, d):
    return watch.replay(spark, f"{d}/events.parquet")


@query(f"""with sy as ({_SY}) select id, '{{"id":"' || id || '","name":"' || name || '","qualified_name":"' || qualified_name || '","kind":"' || kind || '","file_path":"' || file_path || '","start_line":' || start_line || ',"end_line":' || end_line || ',"signature":"' || signature || '","doc_comment":"' || doc_comment || '","visibility":"' || visibility || '"' || case when parent is null then '' else ',"parent":"' || parent || '"' end || '}}' as json from sy""")
def export_json_rows(spark, d):
    return export.json_rows(_symbols(spark, d))
