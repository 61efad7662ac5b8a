"""URL filter with redirect equivalence, in DataFrame operations only.

Rules allow or block a host (with its subdomains) and a path prefix; the longest fitting rule wins.
Redirects and canonical links make URLs aliases: connected components over those edges spread block
decisions to every alias, and an explicit allow rule of a URL takes precedence over what it inherits.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import connected_components
from faultline.llm.store import materialise

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Character references by name, from Python's standard library.
_NAMED = json.dumps(html5)
_DOTTED = r"(?i)/(\.|%2e){1,2}([/?#]|$)"
#: Character references 128-159 stand for characters of Windows-1252.
_C1 = {chr(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.net/en/`` -> (host, path prefix)."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    ``rules`` holds (verdict, rule) and is a parameter, not data.  Equal lengths: the rule that sorts
    first; the same rule with both verdicts: allow.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(set(rules), key=lambda r: (len(r[1]), [-ord(c) for c in r[1]], r[0] == ALLOW)):
        h, p = split_rule(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def url_key(url: Column) -> Column:
    """What identifies a URL as a node: scheme and host lower-cased, fragment dropped, empty path = ``/``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path, query))


def unescape(text: Column) -> Column:
    """HTML character references decoded as in attribute values: names without ``;`` only where no
    letter, digit or ``=`` follows; numbers that are no character become U+FFFD."""
    names = F.from_json(F.lit(_NAMED), "map<string,string>")

    def decoded(part: Column) -> Column:
        digits, hexa = F.regexp_extract(part, "^#([0-9]+)", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+)", 1)
        number = F.when(digits != "", digits).otherwise(F.conv(F.right(F.concat(F.lit("0" * 9), hexa), F.lit(9)), 16, 10))
        number = F.when(F.length(F.ltrim(number, F.lit("0"))) > 9, F.lit(0)).otherwise(F.expr("1") * F.right(number, F.lit(9)).cast("int"))
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        char = F.translate(char, "".join(_C1), "".join(_C1.values()))
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*;?)", 1)
        known = F.when(~part.rlike("^[A-Za-z0-9]+="), F.try_element_at(names, name))
        return F.when((digits != "") | (hexa != ""), F.concat(char, F.regexp_replace(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", ""))) \
                .when(known.isNotNull(), F.concat(known, F.substr(part, F.length(name) + 1))) \
                .otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
    return F.when(F.instr(text, "&") > 0, F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as written, quoted or not; empty if absent."""
    found = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, g) for g in (1, 2, 3)])


def clean(url: Column) -> Column:
    """A URL key with the dot segments of its path resolved."""
    steps = F.split(path_of(url), "/")
    up, here = [".."] + ["%2e.", ".%2e", "%2e%2e"], [".", "%2e"]
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(F.lower(s).isin(here), acc)
                       .when(F.lower(s).isin(up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
                       .otherwise(F.concat(acc, F.array(s))))
    open_end = F.lower(F.element_at(steps, -1)).isin(up + here)
    path = F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    dotted = path_of(url).rlike(_DOTTED)
    site, query = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.when(dotted, F.concat(site, path, query)).otherwise(url)


def resolve(df: DataFrame, base: str, target: str, out: str) -> DataFrame:
    """Adds ``out``: the key of the URL that ``target`` names on the page ``base``, null if it has a
    scheme without ``//``.  Each step is a column of its own, as its parts are used many times."""
    df = df.withColumn("__to", F.regexp_replace(F.trim(F.regexp_replace(target, r"[\t\r\n]", "")), r"(?s)#.*$", ""))
    df = df.withColumns({"__site": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), "__path": path_of(F.col(base))})
    to, site, path = F.col("__to"), F.col("__site"), F.col("__path")
    full = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to) \
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None)) \
            .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to)) \
            .when(F.startswith(to, F.lit("/")), F.concat(site, to)) \
            .when(F.startswith(to, F.lit("?")), F.concat(site, path, to)) \
            .when(to == "", F.col(base)) \
            .otherwise(F.concat(site, F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), to))
    df = df.withColumn("__full", full).withColumn("__key", url_key(F.col("__full")))
    return df.withColumn(out, clean(F.col("__key"))).drop("__to", "__site", "__path", "__full", "__key")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(src, dst)`` of URL keys from the pages' markup: every ``<link rel=canonical href>`` and
    ``<meta http-equiv=refresh content="..; url=..">``.  Character references are decoded; targets are
    resolved against ``<base href>`` or else the page's URL, dot segments too.  A page whose own URL
    has dot segments is linked to the URL without them.  Pages without a URL, and targets such as
    ``mailto:``, give no edge."""
    html = F.col(html_col)
    found = [(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)""", "href"),
             (r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)""", "content")]
    base = F.regexp_extract(html, r"""(?is)(<base\b[^>]*\bhref\s*=[^>]*>)""", 1)

    def named(tag: str, name: str) -> Column:
        every = F.coalesce(F.regexp_extract_all(html, F.lit(tag), 1), F.array().cast("array<string>"))
        return F.transform(every, lambda t: F.struct(F.lit(name).alias("name"), t.alias("tag")))

    tags = F.concat(*[named(tag, name) for tag, name in found])
    tags = pages.select(F.col(url_col).alias("url"), F.coalesce(base, F.lit("")).alias("base"), tags.alias("tags"))
    tags = tags.where((F.size("tags") > 0) | F.col("url").rlike(_DOTTED))
    own = F.array(F.struct(F.lit("own").alias("name"), F.lit("").alias("tag")))
    tags = materialise(tags.select("url", "base", F.explode(F.concat(own, "tags")).alias("t")).select("url", "base", "t.*"), "tags")
    value = F.when(F.col("name") == "href", _attribute(F.col("tag"), "href")).otherwise(_attribute(F.col("tag"), "content"))
    read = tags.select("url", "name", unescape(_attribute(F.col("base"), "href")).alias("base"), unescape(value).alias("value"))
    read = materialise(read, "attributes")
    goal = [F.regexp_extract("value", r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>][^\s">]*))""", g) for g in (1, 2, 3)]
    each = read.select("url", "base", F.when(F.col("name") == "content", F.concat(*goal)).otherwise(F.col("value")).alias("target"))
    each = materialise(resolve(each, "url", "base", "start"), "starts")
    each = each.withColumn("start", F.when((F.col("base") == "") | (F.col("target") == ""), F.col("url")).otherwise(
        F.coalesce("start", "url"))).withColumn("src", url_key(F.col("url")))
    return materialise(resolve(each, "start", "target", "dst").select("src", "dst"), "links").where("src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None,
          default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, inherited)``, one row per input row.

    ``rule`` and its verdict come from the longest fitting rule.  A page without one is blocked if any
    alias (itself a page or only the target of a link) is blocked by its own rule -- ``inherited`` is
    true -- and gets ``default`` otherwise.  ``redirects`` may add edges (``src_url``, ``dst_url``).
    Null URLs and URLs without ``://`` have empty host and path and no aliases.  Null html has no
    links.  Pages that repeat a URL agree; repeated rows stay.  Only URLs are shuffled, never html.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url), "key": url_key(url)})
    name, own = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "own": own})
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select(url_key(F.col("src_url")).alias("src"), url_key(F.col("dst_url")).alias("dst"))
        edges = edges.union(given).union(given.select("src", clean(F.col("src")))).union(given.select("dst", clean(F.col("dst"))))
    parts = materialise(connected_components(edges, "src", "dst"), "aliases")
    _, verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = parts.where(verdict == BLOCK).select(F.col("component")).distinct()
    tainted = materialise(parts.join(blocked, "component").select(F.col("node").alias("__node")), "tainted")
    rows = rows.join(tainted, rows["key"] == tainted["__node"], "left")
    inherited = F.col("own").isNull() & F.col("__node").isNotNull()
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("own", F.when(inherited, F.lit(BLOCK)), F.lit(default)).alias("verdict"),
                       inherited.alias("inherited"))
