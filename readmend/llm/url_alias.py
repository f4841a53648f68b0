"""URL filters that follow redirects and canonical links.

Rules allow or block a host, with its subdomains, and a path prefix; the longest that fits
an url decides. Pages also declare that they are another url: by a canonical link, or by a
refresh that redirects. Urls joined by such edges are aliases: a connected component of them
has one decision, and an url that no rule fits takes it:

    its own rule, or else allow if a rule allows any alias, or else block if a rule blocks
    any alias, or else allow.

An alias need not be a page: rules judge every url that an edge names. Urls are compared
without scheme and fragment, the host in lower case. Relative links are taken against the
page's host, or its folder. Links to nowhere (no host, as mailto:) are no edges.

Everything is a DataFrame expression or join. Rules become a chain of conditions, longest
first, so no row meets a row of rules. Only pages with edges, and the urls they name, take
part in the components; a component is looked up by url, so a hot host is spread.

A null url, or one without ://, has an empty host and path, no rule and no aliases. Repeated
rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmend.llm.components import connected_components
from readmend.llm.common import stored

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Longer lists belong in a table of hosts and a join, not in a chain of conditions.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"
_COMMENT = r"(?s)<!--.*?-->"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end."""
    return F.coalesce(F.translate(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Host, path and query; empty without a host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    host = host_of(url)
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path_of(url), query))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, of, prefix = rule
    return ((host == of) | host.endswith("." + of)) & path.startswith(prefix)


def judged(df: DataFrame, rules=RULES, host: str = "host", path: str = "path") -> DataFrame:
    """With `rule` and `own`: the longest rule that fits, and its verdict, or nulls. Of
    rules of one length that fit, allow goes first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules, got {len(rules)}")
    rule = own = None
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = _fits(F.col(host), F.col(path), r)
        rule = F.when(fits, r[1] + r[2]) if rule is None else rule.when(fits, r[1] + r[2])
        own = F.when(fits, r[0]) if own is None else own.when(fits, r[0])
    none = F.lit(None).cast("string")
    return df.withColumns({"rule": none if rule is None else rule, "own": none if own is None else own})


def _attribute(tag: str, name: str) -> str:
    """SQL for the value of an attribute of a tag, quoted either way or not at all."""
    found = f"""regexp_extract({tag}, '(?is)\\\\s{name}\\\\s*=\\\\s*("([^"]*)"|\\'([^\\']*)\\'|([^\\\\s"\\'>]+))', 1)"""
    return f"trim(BOTH '\"\\'' FROM {found})"


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and refresh redirects that pages declare."""
    html = F.regexp_replace("html", _COMMENT, " ")
    tags = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh")).select(
        "url", F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)).alias("links"),
        F.regexp_extract_all(html, F.lit(_META), F.lit(0)).alias("metas"))
    canonical = F.expr(
        f"transform(filter(links, t -> array_contains(split(lower({_attribute('t', 'rel')}), '\\\\s+'), "
        f"'canonical')), t -> {_attribute('t', 'href')})")
    refresh = F.expr(
        f"transform(filter(metas, t -> lower({_attribute('t', 'http-equiv')}) = 'refresh'), "
        f"t -> trim(BOTH '\"\\'' FROM regexp_extract({_attribute('t', 'content')}, '(?is)url\\\\s*=\\\\s*(.*)$', 1)))")
    target = F.regexp_replace(F.trim("target"), "&amp;", "&")
    return tags.select("url", F.explode(F.concat(canonical, refresh)).alias("target")).select(
        "url", target.alias("target")).where("target <> ''")


def resolved(url: Column, target: Column) -> Column:
    """The url that a link on a page means."""
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)?", 1)
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(site, path_of(url), target))
            .when(target.startswith("#"), url)
            .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target)))


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(key, shared) of every url in an edge (url, target): the verdict of its component,
    null where no rule fits any of its urls."""
    keys = edges.select(key_of(F.col("url")).alias("a"),
                        key_of(resolved(F.col("url"), F.col("target"))).alias("b"))
    keys = stored(keys.where("a <> '' and b <> '' and a <> b").distinct(), "aliases")
    # a node is a key's hash; its two halves together are 128 bits
    def node(c):
        return F.struct(F.xxhash64(c).alias("h"), F.md5(c).alias("m"))

    names = connected_components(keys.select(node("a").alias("u"), node("b").alias("v")))
    urls = keys.select("a").union(keys.select("b")).distinct().select(F.col("a").alias("key"))
    address = F.concat(F.lit("x://"), F.col("key"))
    ruled = judged(urls.withColumns({"host": host_of(address), "path": path_of(address)}), rules).select(
        "key", "own", node("key").alias("node"))
    ruled = ruled.join(names, "node")
    shared = ruled.groupBy("component").agg(
        F.min("own").alias("shared"))  # allow before block, nulls left out
    return ruled.join(shared, "component").select("key", "shared")


def filter_pages(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_verdict) of every page. `edges` (url,
    target) adds redirects known from elsewhere, a crawl's log for one, to those that the
    pages declare."""
    found = page_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select("url", "target"))
    shared = stored(alias_verdicts(found, rules), "alias-verdicts").select(
        F.col("key").alias("alias_key"), "shared")
    url = F.col("url")
    rows = judged(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                               key_of(url).alias("url_key")), rules)
    rows = rows.join(shared, (rows.url_key == shared.alias_key) & rows.own.isNull(), "left")
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("own", "shared", F.lit("allow")).alias("verdict"),
                       F.col("shared").alias("alias_verdict"))


def oracle(table: str = "pages", rules=RULES) -> str:
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))

    def case(pick, host, path):
        return "case " + " ".join(
            f"when ({host} = '{r[1]}' or ends_with({host}, '.{r[1]}')) and starts_with({path}, '{r[2]}') "
            f"then '{pick(r)}'" for r in order) + " end"

    def parts(url):
        host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
        return (f"coalesce({host}, '') host, "
                f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, "
                f"coalesce(regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') query")

    def attribute(tag, name):
        return (f"""trim(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*("([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1), '"''')""")

    return rf"""
with recursive p as (select page_id, url, {parts('url')},
    regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') h from {table}),
links as (select url, host, path, unnest(regexp_extract_all(h, '(?is)<link\b[^>]*>')) t from p),
metas as (select url, host, path, unnest(regexp_extract_all(h, '(?is)<meta\b[^>]*>')) t from p),
raw as (select url, host, path, {attribute('t', 'href')} target from links
        where list_contains(string_split_regex(lower({attribute('t', 'rel')}), '\s+'), 'canonical')
        union all
        select url, host, path, trim(regexp_extract({attribute('t', 'content')}, '(?is)url\s*=\s*(.*)$', 1), '"''')
        from metas where lower({attribute('t', 'http-equiv')}) = 'refresh'),
tidy as (select url, host, path, replace(trim(target), '&amp;', '&') target from raw),
full_ as (select url, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') then target
    when starts_with(target, '//') then 'http:' || target
    when starts_with(target, '/') then 'http://' || host || target
    when starts_with(target, '?') then 'http://' || host || path || target
    when starts_with(target, '#') then url
    else 'http://' || host || case when regexp_extract(path, '(?s)^(.*/)?', 1) = '' then '/'
         else regexp_extract(path, '(?s)^(.*/)?', 1) end || target end target from tidy where target <> ''),
ends as (select a.host || a.path || a.query x, b.host || b.path || b.query y
    from (select row_number() over () r, {parts('url')} from full_) a
    join (select row_number() over () r, {parts('target')} from full_) b using (r)
    where a.host <> '' and b.host <> ''),
edges as (select x, y from ends where x <> y union select y, x from ends where x <> y),
reach(x, y) as (select x, x from edges union select reach.x, edges.y from reach join edges on reach.y = edges.x),
comp as (select x, min(y) c from reach group by x),
own as (select x, c, {case(lambda r: r[0], 'host', 'path')} v
        from (select x, c, {parts("('x://' || x)")} from comp)),
shared as (select x, min(v) over (partition by c) v from own)
select page_id, host, path, {case(lambda r: r[1] + r[2], 'host', 'path')} rule,
       coalesce({case(lambda r: r[0], 'host', 'path')}, s.v, 'allow') verdict,
       case when {case(lambda r: r[0], 'host', 'path')} is null then s.v end alias_verdict
from p left join (select distinct x, v from shared) s on p.host <> '' and s.x = p.host || p.path || p.query"""
