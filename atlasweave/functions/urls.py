"""URL parsing, resolution and canonical forms as column expressions.

A URL is parsed once into ``<prefix>_scheme/_user/_host/_port/_path/_query`` columns by
:func:`with_url_parts`; everything else is composed from those parts, so each regular
expression runs once per row.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .hosts import ascii_host
from .stages import let, stage
from .text import percent_decode, strip

_GRAMMAR = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_HOST = r'^(\[[0-9a-f:.]+\]|[^\x00-\x20"%/:<>?@\\\[\]^`{|}]+)$'
#: Full-width forms of what a host must not hold; apart, as the pattern above is far faster while it names ASCII alone.
_HOST_WIDE = r"[\uff02\uff05\uff0f\uff1a\uff1c\uff1e\uff1f\uff20\uff3b-\uff3e\uff40\uff5b-\uff5d]"
_PATH_UNSAFE = r'[^\x21-\x7e]|["<>`{}^]'
_QUERY_UNSAFE = r"""[^\x21-\x7e]|["<>#']"""
#: A URL whose parts need no more than cutting: no user, no folded or encoded character, a short port without leading zero.
_PLAIN = (
    r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.\-]++(?::[1-9][0-9]{0,3})?+(?:/(?!\.|%2[Ee])[!$-.0-;=@-\[\]_a-z|~]*+)*+"
    r"(?:\?[!$-&(-;=?-~]*+)?+(?:#|\z)"
)
#: A path from the root or from the page's folder that stays as it is behind them: no dot segments, schemes or encoded characters.
_PLAIN_PATH = (
    r"^(?:/(?!/)|(?=[A-Za-z0-9_\-]))(?!\.|%2[Ee])[!$-.0-9;=@-\[\]_a-z|~]*+(?:/(?!\.|%2[Ee])[!$-.0-;=@-\[\]_a-z|~]*+)*+"
    r"(?:\?[!$-&(-;=?-~]*+)?+(?:#|\z)"
)
PARTS = ("scheme", "user", "host", "port", "path", "query")


def _percent_encode(text: Column, unsafe: str) -> Column:
    def one(c: Column) -> Column:
        return (
            F.when(~c.rlike(unsafe), c).when(c == " ", "%20").otherwise(F.url_encode(c))
        )

    return F.when(
        text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), one), "")
    ).otherwise(text)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    steps = F.split(F.regexp_replace(path, "(?i)%2e", "."), "/")
    folded = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    return F.when(
        path.rlike(r"(?i)/(\.|%2e)"), F.regexp_replace(joined, "^//$", "/")
    ).otherwise(path)


def _plain_parts(url: Column) -> Column:
    """The parts of a URL that :data:`_PLAIN` matches, which stands in its normal form but for letters and a default port."""
    whole = F.substring_index(url, "#", 1)

    def parts(w: Column) -> Column:
        before = F.substring_index(w["w"], "?", 1)
        return let(
            F.struct(w["s"].alias("s"), F.substring(before, F.length(w["s"]) + 4, F.length(w["w"])).alias("r"),
                     F.substring(w["w"], F.length(before) + 1, F.length(w["w"])).alias("q")),
            lambda x: let(
                F.struct(F.lower(x["s"]).alias("s"), F.substring_index(x["r"], "/", 1).alias("a"), x["r"].alias("r"), x["q"].alias("q")),
                lambda y: _parts(
                    y["s"], F.lit(""), F.lower(F.substring_index(y["a"], ":", 1)),
                    F.when(y["a"].contains(":"), F.substring_index(y["a"], ":", -1)).otherwise(""),
                    F.when(F.length(y["a"]) == F.length(y["r"]), "/").otherwise(F.substring(y["r"], F.length(y["a"]) + 1, F.length(y["r"]))),
                    y["q"],
                ),
            ),
        )

    return let(F.struct(whole.alias("w"), F.substring_index(whole, "://", 1).alias("s")), parts)


def _parts(scheme: Column, user: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    values = (scheme, user, host, F.when(default, "").otherwise(port), path, query)
    return F.struct(*[v.alias(n) for n, v in zip(PARTS, values)])


def _any_parts(url: Column) -> Column:
    """The parts of any URL, its host still in Unicode; null when it is not an http(s) URL."""

    def cut(t: Column) -> Column:
        path = F.replace(F.coalesce(F.nullif(F.regexp_extract(t, _GRAMMAR, 3), F.lit("")), F.lit("/")), F.lit("\\"), F.lit("/"))
        return F.struct(
            F.lower(F.regexp_extract(t, _GRAMMAR, 1)).alias("s"), F.regexp_extract(t, _GRAMMAR, 2).alias("a"), path.alias("path"),
            F.regexp_extract(t, _GRAMMAR, 4).alias("q"),
        )

    def clean(c: Column) -> Column:
        a = c["a"]
        return F.struct(
            c["s"].alias("s"), F.regexp_extract(a, "^(.*)@", 1).alias("user"),
            F.lower(F.replace(F.regexp_replace(F.regexp_replace(a, "^.*@", ""), ":[0-9]*$", ""), F.lit("Σ"), F.lit("σ"))).alias("host"),
            F.regexp_replace(F.regexp_extract(a, ":([0-9]*)$", 1), "^0+([0-9])", "$1").alias("port"),
            let(c["path"], _fold_dots).alias("path"), _percent_encode(c["q"], _QUERY_UNSAFE).alias("q"),
        )

    def checked(c: Column) -> Column:
        host, port = c["host"], c["port"]
        valid = (
            c["s"].isin("http", "https")
            & host.rlike(_HOST)
            & ((F.octet_length(host) == F.char_length(host)) | ~host.rlike(_HOST_WIDE))
            # Digits without leading zeros, compared as text: a failed cast of an empty port raises and catches an error per row.
            & ((F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535")))
        )
        path = let(c["path"], lambda p: _percent_encode(p, _PATH_UNSAFE))
        return F.when(valid, _parts(c["s"], c["user"], host, port, path, c["q"]))

    text = F.regexp_replace(strip(url), "[\t\n\r]", "")
    return let(text, lambda t: let(cut(t), lambda c: let(clean(c), checked)))


def is_plain(url: Column) -> Column:
    """Whether ``url`` is a whole URL that stands in its normal form but for letters and a default port."""
    return F.coalesce(url.rlike(_PLAIN), F.lit(False))


@lru_cache(maxsize=4)
def _url_parts(plain: str, gateway: object) -> Column:
    """The parts of column ``_unparsed``: made once for a JVM, as hundreds of calls build the expression, and a query parses URLs many times."""
    return let(F.col("_unparsed"), lambda t: F.when(t.rlike(plain), _plain_parts(t)).otherwise(_any_parts(t)))


def with_url_parts(df: DataFrame, url: Column, p: str) -> DataFrame:
    """Add the parts of ``url`` under prefix ``p``; all are null when it is not an http(s) URL.

    One step over a row: a URL in plain form is cut at its delimiters, and only others meet the whole grammar.
    """
    names = [f"{p}_{n}" for n in PARTS]
    others = [c for c in df.columns if c not in names]
    df = df.select(*others, url.alias("_unparsed")).select(*others, F.inline(F.array(_url_parts(_PLAIN, SparkContext._gateway))).alias(*names))
    return stage(df, **{f"{p}_host": ascii_host(f"{p}_host")}).select(*others, *names)


def drop_parts(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[f"{p}_{n}" for p in prefixes for n in PARTS])


def origin(p: str) -> Column:
    user, port = F.col(f"{p}_user"), F.col(f"{p}_port")
    return F.concat(
        F.col(f"{p}_scheme"),
        F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        F.col(f"{p}_host"),
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
    )


def href(p: str) -> Column:
    """The normalised URL text of a parsed URL, without fragment; null when unparseable."""
    return F.concat(origin(p), F.col(f"{p}_path"), F.col(f"{p}_query"))


def is_fetchable(raw: Column) -> Column:
    """Not empty, not a fragment, and with no scheme other than http or https."""
    value = strip(raw)
    scheme = F.lower(F.regexp_extract(value, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return (value != "") & ~value.startswith("#") & scheme.isin("", "http", "https")


def with_resolved(df: DataFrame, raw: str, base: str, out: str = "resolved", parsed: str | None = None) -> DataFrame:
    """Resolve the ``raw`` reference of each row against its ``base`` URL into ``out``.

    Where the base is already parsed, as for all references of one page, name its prefix
    in ``parsed``.
    """
    b = parsed or "_b"
    text = F.col(raw)
    whole = text.rlike(_PLAIN)
    if parsed is None:
        # The base of a reference that is a plain URL itself is never looked at.
        df = with_url_parts(df, F.when(whole, F.lit(None)).otherwise(F.col(base)), b)
    folder = F.regexp_replace(F.col(f"{b}_path"), "[^/]*$", "")

    def with_slashes(value: Column) -> Column:
        same = F.lower(F.regexp_extract(value, "(?i)^(https?):", 1)) == F.col(f"{b}_scheme")
        return (
            F.when(~value.rlike("(?i)^https?:"), value)
            .when(value.rlike(r"(?i)^https?:[/\\]{2}"), F.regexp_replace(value, r"^([A-Za-z]+):[/\\]+", "$1://"))
            .when(same, F.regexp_replace(value, "(?i)^https?:", ""))
            .otherwise(F.regexp_replace(value, r"^([A-Za-z]+):[/\\]*", "$1://"))
        )

    def absolute(r: Column) -> Column:
        return (
            F.when(r.rlike("(?i)^https?://"), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(F.col(f"{b}_scheme"), F.lit("://"), F.regexp_replace(r, r"^[/\\]+", "")))
            .when(r.rlike(r"^[/\\]"), F.concat(origin(b), r))
            .when(r == "", href(b))
            .when(r.startswith("?"), F.concat(origin(b), F.col(f"{b}_path"), r))
            .otherwise(F.concat(origin(b), folder, r))
        )

    fetched = F.when(is_fetchable(text), F.regexp_replace(strip(text), "[\t\n\r]", ""))
    # Behind a parsed base such a path is whole as it stands, so nothing is parsed again.
    joined = F.when(
        text.rlike(_PLAIN_PATH) & (F.col(f"{b}_user") == "") & F.col(f"{b}_host").isNotNull(),
        F.concat(origin(b), F.when(text.startswith("/"), "").otherwise(folder), F.substring_index(text, "#", 1)),
    )
    df = df.withColumn("_joined", joined)
    other = F.when(whole, text).otherwise(let(fetched, lambda v: let(with_slashes(v), absolute)))
    df = with_url_parts(df, F.when(F.col("_joined").isNull(), other), "_u")
    df = stage(df, **{out: F.coalesce("_joined", href("_u"))})
    df = drop_parts(df, "_u").drop("_joined")
    return df if parsed else drop_parts(df, b)


def query_pairs(query: Column) -> Column:
    """Decoded ``(k, v)`` pairs of a query string, in order."""
    decode = lambda s: F.when(
        s.contains("%") | s.contains("+"), F.coalesce(F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")), s)
    ).otherwise(s)
    raw = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda s: s != "")
    return F.transform(
        raw,
        lambda s: F.struct(
            decode(F.substring_index(s, "=", 1)).alias("k"),
            decode(
                F.when(s.contains("="), F.substring(s, F.instr(s, "=") + 1, F.length(s))).otherwise("")
            ).alias("v"),
        ),
    )


def _dropped_key(key: Column, cache_busters: bool) -> Column:
    names = K.TRACKING_KEYS + (K.CACHE_BUSTER_KEYS if cache_busters else [])
    return F.lower(key).isin(*names) | F.lower(key).startswith("utm_")


def _canonical_query(query: Column, cache_busters: bool) -> Column:
    kept = F.filter(query_pairs(query), lambda e: ~_dropped_key(e["k"], cache_busters))
    ordered = F.sort_array(F.transform(kept, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    text = F.array_join(
        F.transform(ordered, lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"]))), "&"
    )
    return F.when(query.isin("", "?"), "").otherwise(
        let(text, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise(""))
    )


def with_canonical(
    df: DataFrame, url: str, out: str = "canonical_url", page: bool = False, cache_busters: bool = True
) -> DataFrame:
    """Add the identity form of ``url``; with ``page`` also fold index files and trailing slashes."""
    df = with_url_parts(df, F.col(url), "_c")
    host = F.regexp_replace(F.col("_c_host"), r"\.$", "")
    path = F.regexp_replace(F.col("_c_path"), "/{2,}", "/")
    if page:
        path = F.regexp_replace(path, K.INDEX_FILE_REGEX, "/")
        path = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
    df = df.withColumns({"_c_host": host, "_c_path": path})
    df = df.withColumn("_c_query", let(F.col("_c_query"), lambda q: _canonical_query(q, cache_busters)))
    df = stage(df, **{out: F.coalesce(href("_c"), F.col(url))})
    return drop_parts(df, "_c")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def filename(p: str, url: Column) -> Column:
    """Decoded last path segment of a parsed URL, else its host, else the raw last segment."""
    last = F.try_element_at(path_segments(F.col(f"{p}_path")), F.lit(-1))
    raw = F.element_at(F.split(url, "/"), -1)
    return F.when(
        F.col(f"{p}_host").isNotNull(), F.coalesce(percent_decode(last), F.col(f"{p}_host"))
    ).otherwise(F.coalesce(F.nullif(raw, F.lit("")), url))


def with_filename(df: DataFrame, url: str, out: str = "filename") -> DataFrame:
    df = with_url_parts(df, F.col(url), "_f")
    return drop_parts(stage(df, **{out: filename("_f", F.col(url))}), "_f")


def _suffix(name: Column, low: int, high: int) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, rf"(?i)\.([a-z0-9]{{{low},{high}}})$", 1)), F.lit(""))


def image_extension(name: Column) -> Column:
    """Extension of a file name when it is a known image type."""
    ext = _suffix(name, 2, 5)
    return F.when(ext.isin(*K.IMAGE_EXTENSIONS), ext)


def any_extension(name: Column) -> Column:
    """Known image extension, else any plausible one."""
    return F.coalesce(image_extension(name), _suffix(name, 2, 8))


def geo_format(name: Column) -> Column:
    """Geographic format a file name implies, or null."""
    ext = _suffix(name, 2, 8)
    return F.when(ext.isin(*K.GEO_EXTENSIONS), ext).when(
        (ext == "zip") & name.rlike(K.SHAPEFILE_ZIP_REGEX), "shapefile-zip"
    )


def page_like(path: Column) -> Column:
    """False for paths whose extension can never be an HTML page; false when unparseable."""
    ext = F.lower(F.regexp_extract(path, r"(?i)\.([a-z0-9]{1,8})$", 1))
    return F.coalesce(~ext.isin(*K.NON_PAGE_EXTENSIONS), F.lit(False))


def registrable_domain(host: Column) -> Column:
    parts = F.split(F.lower(host), r"\.")
    n = F.size(parts)
    deep = (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*K.SECOND_LEVEL_LABELS)
    keep = F.when(n <= 2, n).when(deep, 3).otherwise(2)
    return F.array_join(F.slice(parts, n - keep + 1, keep), ".")


def same_site(host: Column, site_host: Column, subdomains: bool) -> Column:
    same = host == site_host
    if subdomains:
        base = registrable_domain(site_host)
        same = same | (host == base) | F.endswith(host, F.concat(F.lit("."), base))
    return F.coalesce(same, F.lit(False))


def readable_segments(path: Column) -> Column:
    """Path segments decoded, page suffix dropped, separators as blanks."""
    return F.transform(
        path_segments(path),
        lambda s: strip(
            F.regexp_replace(F.regexp_replace(percent_decode(s), K.PAGE_SUFFIX_REGEX, ""), "[-_+]+", " ")
        ),
    )


def with_page_label(df: DataFrame, url: str, out: str = "page_label") -> DataFrame:
    """``host → segment → segment`` trail of a page URL."""
    df = with_url_parts(df, F.col(url), "_l")
    named = F.slice(F.filter(readable_segments(F.col("_l_path")), lambda s: s != ""), 1, 4)
    host = F.regexp_replace(F.col("_l_host"), r"^www\.", "")
    label = F.coalesce(F.array_join(F.concat(F.array(host), named), " → "), F.col(url))
    return drop_parts(stage(df, **{out: label}), "_l")


def with_url_places(df: DataFrame, url: str, out: str = "places") -> DataFrame:
    """Place names a page URL path implies, broadest first."""
    df = with_url_parts(df, F.col(url), "_l")
    places = F.slice(
        F.filter(readable_segments(F.col("_l_path")), lambda s: (F.length(s) > 1) & (F.length(s) < 60)), 1, 5
    )
    empty = F.array().cast("array<string>")
    return drop_parts(stage(df, **{out: F.coalesce(places, empty)}), "_l")


def with_variant_group(df: DataFrame, url: str, out: str = "variant_group") -> DataFrame:
    """Key shared by responsive derivatives of one artwork; null when the URL shows no sign of one."""
    df = stage(with_url_parts(df, F.col(url), "_v"), _name=filename("_v", F.col(url)))
    name = F.col("_name")
    dotted = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    svg = dotted & (F.lower(F.element_at(F.split(name, r"\."), -1)) == "svg")
    df = stage(df, _stem=stem)
    bare = F.col("_stem")
    for _ in range(3):
        bare = F.regexp_replace(bare, K.RESPONSIVE_SUFFIX_REGEX, "")
    df = stage(df, _bare=bare)
    resized = F.exists(query_pairs(F.col("_v_query")), lambda e: F.lower(e["k"]).isin(*K.RESIZE_KEYS))
    port = F.col("_v_port")
    key = F.concat(
        F.col("_v_host"),
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
        F.regexp_replace(F.col("_v_path"), "[^/]*$", ""),
        F.col("_bare"),
        F.when(svg, "#svg").otherwise("#raster"),
    )
    df = stage(df, **{out: F.when((F.col("_bare") != F.col("_stem")) | resized, key)})
    return drop_parts(df, "_v").drop("_name", "_stem", "_bare")


def short_id(prefix: str, seed: Column, digits: int = 16) -> Column:
    """Deterministic id: prefix and the first hex digits of the seed's SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(seed), 1, digits))


def asset_id(scan_id: Column, canonical: Column) -> Column:
    return short_id("img", F.concat(scan_id, F.lit("|"), canonical), 20)
