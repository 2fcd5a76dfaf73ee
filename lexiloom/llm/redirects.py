"""URL filters by redirect equivalence: block decisions reach every alias of a page.

Aliases are URLs of one normal form, and URLs that redirects (a table of them, or a page's meta refresh)
or canonical links connect, over any number of steps: the connected components of the edge table. A
component with a blocked member is blocked; a URL that is allowed explicitly is kept in any case.

Hosts are decided by a table of rules, which is joined by host and so may have any size; patterns are for
the few rules that need more than a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components

#: Domains of spam and adult pages, blocked with all their subdomains.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Hosts that are kept in any case, without their subdomains; none is known in the tables.
ALLOWED_HOSTS: tuple[str, ...] = ()
_TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"
#: Scheme and host, which are lower-cased; the rest of a URL is not.
_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?[^/?#]*"
#: Applied in turn: (pattern, replacement).
NORMAL = (
    (r"#.*$", ""),
    (r"^([a-z][a-z0-9+.-]*:)?//", ""),
    (r"^[^/?@]*@", ""),
    (r"^(www|m|amp|mobile)\.", ""),
    (r"^([^/?:]*):(80|443)([/?]|$)", r"$1$3"),
    (r"([?&])" + _TRACKING + r"=[^&]*", r"$1"),
    (r"[?&]+$", ""),
    (r"\?&+", "?"),
    (r"&&+", "&"),
    (r"(/index)?\.(html?|php)$", ""),
    (r"/+$", ""),
)
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?([^"'\s>;]+)"""
#: In the lower-cased URL.
_HOST = r"^([a-z][a-z0-9+.-]*:)?(//)?([^/?#@]*@)?([^/?#:]*)"


def normal_form(url: Column) -> Column:
    """A URL without scheme, user, fragment, mobile host, default port, tracking parameters and page suffix; the host in lower case."""
    x = F.trim(url)
    head = F.regexp_extract(x, _HEAD, 0)
    x = F.concat(F.lower(head), F.substr(x, F.length(head) + 1))
    for pattern, to in NORMAL:
        x = F.regexp_replace(x, pattern, to)
    return x


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case, without a dot at its end."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), _HOST, 4), r"[.]$", "")


def host_rules(spark: SparkSession, blocked=BLOCKED_HOSTS, allowed=ALLOWED_HOSTS) -> DataFrame:
    """(host, subdomains, rule) of lists of hosts: blocked with their subdomains, allowed without."""
    rows = [(h, True, "block") for h in blocked] + [(h, False, "allow") for h in allowed]
    return spark.createDataFrame(rows, "host string, subdomains boolean, rule string")


def _matches(url: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(url.rlike(p), F.lit(False))
    return hit


def _ruled(urls: DataFrame, hosts: DataFrame | None, block, allow) -> DataFrame:
    """urls, with the column rule: what hosts and patterns say of the column url, 'allow' before 'block', else null."""
    own = F.when(_matches(F.col("url"), allow), 0).when(_matches(F.col("url"), block), 1)
    if hosts is None:
        return urls.withColumn("rule", F.when(own == 0, "allow").when(own == 1, "block"))
    # a host and the domains that it is below, each once: few rows, as hosts repeat
    known = urls.where("url is not null").select(host_of(F.col("url")).alias("host")).distinct()
    parts = F.split("host", "[.]")
    each = known.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("i", "domain"))
    given = hosts.select(F.lower(hosts["host"]).alias("named"), hosts["subdomains"].alias("subdomains"), hosts["rule"].alias("given"))
    hit = each.join(given, F.col("domain") == F.col("named")).where("i = 0 or subdomains")
    best = hit.groupBy("host").agg(F.min(F.when(F.col("given") == "allow", 0).otherwise(1)).alias("by_host")).withColumnRenamed("host", "of_host")
    joined = urls.withColumn("host", host_of(F.col("url"))).join(best, F.col("host") == F.col("of_host"), "left")
    rank = F.least(own, F.col("by_host"))
    return joined.withColumn("rule", F.when(rank == 0, "allow").when(rank == 1, "block")).drop("host", "of_host", "by_host")


def _absolute(target: Column, url: Column) -> Column:
    host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(target == "", None).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("/"), F.concat(host, target)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"([^/:])/[^/]*$", "$1"), F.lit("/"), target))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): a page's URL and the one that its canonical link or meta refresh names."""
    page = pages.select(pages["url"].alias("url"), pages["html"].alias("html")).where("url is not null and html is not null")
    canonical = F.regexp_extract(F.regexp_extract("html", _LINK, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1)
    targets = page.where(F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")).select("url", F.explode(F.array(canonical, refresh)).alias("target"))
    return targets.select(F.col("url").alias("src"), _absolute(F.col("target"), F.col("url")).alias("dst")).where("dst is not null")


def redirect_decisions(pages: DataFrame, redirects: DataFrame | None = None, hosts: DataFrame | None = None, block=(), allow=()) -> DataFrame:
    """(page_id, url, rule, decision) of every page.

    rule: what hosts and patterns say of the URL itself, 'allow' before 'block', else null. decision: 'allow'
    where the rule is; else 'block' where any URL of the component is blocked by its rule; else 'pass'.
    hosts: (host, subdomains, rule), see host_rules; host_rules' own unless it, block or allow is given. block, allow: regular
    expressions on the URL as it is given. redirects: (src, dst) URLs of known redirects. A blocked URL that
    one of them, a canonical link or a meta refresh names counts though it has no page. An allowed URL that is
    blocked by another rule too blocks nobody. A null url has a null rule and passes; an empty one is a URL like others; a null html has no links; rows that repeat
    are decided each, equal pages alike; chains and loops of any length are one component; other columns are
    not read. An empty table gives no rows. URLs meet by 64-bit hashes of their normal forms.
    """
    if hosts is None and not block and not allow:
        hosts = host_rules(pages.sparkSession)
    page = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"))
    node = F.xxhash64(normal_form(F.col("url")))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(redirects["src"], redirects["dst"]).where("src is not null and dst is not null"))
    ends = edges.select(F.xxhash64(normal_form(F.col("src"))).alias("src"), F.xxhash64(normal_form(F.col("dst"))).alias("dst")).where("src <> dst")
    group = components(ends).withColumnRenamed("node", "at")
    own = _ruled(page, hosts, block, allow).withColumn("node", F.when(F.col("url").isNotNull(), node))
    own = own.join(group, F.col("node") == F.col("at"), "left").select("page_id", "url", "rule", F.coalesce("component", "node").alias("class"))
    bad = own.where("rule = 'block'").select(F.col("class").alias("bad"))
    both = _ruled(edges.select(F.explode(F.array("src", "dst")).alias("url")), hosts, block, allow).where("rule = 'block'")
    named = both.select(node.alias("node")).join(group, F.col("node") == F.col("at"), "left")
    bad = bad.union(named.select(F.coalesce("component", "node")))
    out = own.join(bad.distinct(), F.col("class") == F.col("bad"), "left")
    return out.select("page_id", "url", "rule", F.when(F.col("rule") == "allow", "allow").when(F.col("bad").isNotNull(), "block").otherwise("pass").alias("decision"))


def fixture_redirects(pages: DataFrame) -> DataFrame:
    """(src, dst): redirects for a test of chains, as the tables hold none. Not what the pages say: each page whose URL came from a feed leads to the page of the next id."""
    own = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"))
    to = own.select((F.col("page_id") - 1).alias("before"), F.col("url").alias("dst"))
    return own.where("url like '%utm_source=feed%'").join(to, F.col("page_id") == F.col("before")).select(F.col("url").alias("src"), "dst")


def _sql_normal(url: str) -> str:
    x = f"(lower(regexp_extract(trim({url}), '{_HEAD}', 0)) || substr(trim({url}), length(regexp_extract(trim({url}), '{_HEAD}', 0)) + 1))"
    for pattern, to in NORMAL:
        to = to.replace("$1", r"\1").replace("$3", r"\3")
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _sql(edges: str) -> str:
    q = lambda x: x.replace("'", "''")
    names = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return rf"""
with recursive t as (select page_id, url, html, {_sql_normal("url")} node, regexp_replace(regexp_extract(lower(trim(url)), '{_HOST}', 4), '[.]$', '') host from pages),
b(h) as (values {names}),
bh as (select distinct host from (select distinct host from t) x, b where host = h or ends_with(host, '.' || h)),
p as (select t.*, case when bh.host is not null then 'block' end as rule from t left join bh on bh.host = t.host),
l as (select url, node, unnest([regexp_extract(regexp_extract(html, '{q(_LINK)}'), '{q(_HREF)}', 1), regexp_extract(regexp_extract(html, '{q(_REFRESH)}'), '{q(_TARGET)}', 1)]) target from p where html is not null and url is not null),
a as (select node, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') then target when starts_with(target, '//') then 'http:' || target when starts_with(target, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || target
  else regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '') || '/' || target end as dst from l where target <> ''),
e as (select node a, {_sql_normal("dst")} b from a{edges}),
s as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from s union select r.a, s.b from r join s on r.b = s.a),
g as (select a node, min(b) class from r group by 1),
c as (select p.*, coalesce(g.class, p.node) class from p left join g on g.node = p.node),
bad as (select distinct class from c where rule = 'block')
select page_id, url, rule, case when bad.class is not null then 'block' else 'pass' end as decision from c left join bad on bad.class = c.class
"""


SQL = _sql("")
CHAINS_SQL = _sql(" union all select x.node, y.node from p x join p y on y.page_id = x.page_id + 1 where x.url like '%utm_source=feed%' and y.url is not null")
