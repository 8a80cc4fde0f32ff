"""URL filters with redirect equivalence: aliases share block decisions, explicit allows come first.

Canonical links and refresh redirects of pages, and given redirects, are edges between URLs; their connected
components are sets of aliases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.components import connected_components
from pagelake.llm.store import discard, stash

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://' or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """What tells URLs apart: host, path ('/' if empty) and query; scheme and fragment don't."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when((host_of(url) != "") & ~rest.startswith("/"), F.lit("/")).otherwise(F.lit("")), rest)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct<text, verdict>, or null: host or a subdomain of it, and path's start."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits & (host != ""), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


#: Characters of URLs and how references to them may be written; '&' comes last, so that none is made anew.
REFERENCES = {c: f"&{name};|&#0*{ord(c)};|&#[xX]0*{ord(c):x};|&#[xX]0*{ord(c):X};" for c, name in (("/", "sol"), (":", "colon"), ("?", "quest"), ("=", "equals"), ("#", "num"), (".", "period"), ("&", "amp"))}


def decoded(text: Column) -> Column:
    for c, written in REFERENCES.items():
        text = F.regexp_replace(text, written, c)
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, decoded; '' without one."""
    value = lambda form: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{form}", 1)
    return F.trim(decoded(F.coalesce(*[F.nullif(value(form), F.lit("")) for form in (r'"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL, seen from a base URL: with a scheme, from '//', from '/', from '?', else beside the base's last path segment."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    plain = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    path = F.when(plain == "", path_of(base)).when(plain.startswith("/"), plain).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    segments = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    path = F.array_join(F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.element_at(segments, 1)), step), "/")
    return (
        F.when(link.rlike(r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .otherwise(F.concat(origin, path, tail))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """a, b: keys of a page's URL and of its canonical link or refresh target, relative ones resolved; comments and scripts are no markup."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.where(F.col("url").isNotNull() & html.rlike("(?i)canonical|http-equiv"))
    rows = rows.select("url", F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template)\b.*?(?:</\1\s*>|$)", " ").alias("markup"))
    # every tag is matched, with its values, so what looks like a tag inside a value is none
    tags = F.regexp_extract_all("markup", F.lit(r"(?s)</?[a-zA-Z](?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>"), F.lit(0))
    named = lambda names: F.filter("tags", lambda t: t.rlike(rf"(?is)^<(?:{names})[\s/]"))
    rows = rows.withColumn("tags", F.filter(tags, lambda t: t.rlike(r"(?is)^<(?:base|link|meta)[\s/]")))
    rows = rows.select("url", F.try_element_at(named("base"), F.lit(1)).alias("base"), F.explode(named("link|meta")).alias("tag"))
    tag = F.col("tag")
    canonical = attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = F.lower(attribute(tag, "http-equiv")) == "refresh"
    target = F.regexp_extract(attribute(tag, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    link = F.when(tag.rlike("(?i)^<link") & canonical, attribute(tag, "href")).when(tag.rlike("(?i)^<meta") & refresh, F.trim(target))
    rows = rows.select("url", attribute(F.coalesce("base", F.lit("")), "href").alias("base"), link.alias("link")).where("link <> ''")
    rows = rows.select("url", "link", F.when(F.col("base") == "", F.col("url")).otherwise(resolved(F.col("base"), F.col("url"))).alias("base"))
    rows = rows.select("url", resolved(F.col("link"), F.col("base")).alias("to_url"))
    return rows.select(key_of(F.col("url")).alias("a"), key_of(F.col("to_url")).alias("b"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (text of the rule that fits, else null), verdict of each page's URL.

    Without a rule of its own, a URL follows its aliases: allow if a rule allows one of them, else block if a
    rule blocks one, else allow. redirects: further edges, columns from_url and to_url. Null URLs and ones
    without '://' have empty host and path, fit no rule and have no alias. Each row is judged, repeated ones and those
    without page_id too; null html has no links. Further columns are ignored; an empty table gives an empty result.
    Decisions are joined by URL, so neither pages nor edges need to fit anywhere.
    """
    edges = page_links(pages)
    if redirects is not None:
        given = redirects.select(key_of(F.col("from_url")).alias("a"), key_of(F.col("to_url")).alias("b"))
        edges = edges.union(given)
    edges = stash(edges, "links")
    alias = connected_components(edges.where("a <> '' and b <> ''"))  # node, component: only URLs with an edge
    discard(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    own = rule_of(host_of(url), path_of(url), rules)["verdict"]
    decided = alias.withColumn("own", own).groupBy("component").agg(F.bool_or(F.col("own") == ALLOW).alias("allowed"), F.bool_or(F.col("own") == BLOCK).alias("blocked"))
    decided = alias.join(decided, "component").where(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).select(F.col("node").alias("blocked_key"))
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    p = p.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # rows without a host have no alias and all the same key, so they take no part in the join
    p = p.where("host <> ''").join(decided, F.col("key") == F.col("blocked_key"), "left").unionByName(p.where("host = ''").withColumn("blocked_key", F.lit(None).cast("string")))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked_key").isNotNull(), BLOCK).otherwise(ALLOW))
    return p.select("page_id", "host", "path", F.col("found.text").alias("rule"), verdict.alias("verdict"))
