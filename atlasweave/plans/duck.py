"""SQL fragments for the DuckDB checks.

These are written from the definitions (URL standard, form encoding, HTML tag grammar), in
DuckDB's own functions, and are independent of the Spark expressions they check.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.text import SPACE
from ..views import with_views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(str(v)) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(str(v)) for v in values) + "]"


def case_map(expr: str, mapping: dict, otherwise: str = "NULL") -> str:
    lines = " ".join(f"WHEN {k if isinstance(k, int) else q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {lines} ELSE {otherwise} END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(f'{SPACE}+')}, ' ', 'g'))"


def clean(x: str, limit: int = 500) -> str:
    return f"substr(nullif({squish(x)}, ''), 1, {limit})"


def tokens(x: str) -> str:
    spaced = f"regexp_replace(lower({x}), '%[0-9a-f]{{2}}', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({spaced}, '[^a-z0-9]+'), lambda w: w <> '')"


def decode(x: str) -> str:
    """Percent-decoding that leaves malformed text and plus signs alone."""
    bad = q("%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)")
    return f"CASE WHEN regexp_matches({x}, {bad}) THEN {x} ELSE url_decode({x}) END"


def entities(x: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def form_encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def _encode(x: str, unsafe: str) -> str:
    one = f"CASE WHEN NOT regexp_matches(c, {q(unsafe)}) THEN c WHEN c = ' ' THEN '%20' ELSE url_encode(c) END"
    return f"list_aggregate(list_transform(string_split({x}, ''), lambda c: {one}), 'string_agg', '')"


def parts(src: str, url: str, p: str) -> str:
    """Sub-select adding scheme, host, port, path and query of ``url`` (null unless http(s))."""
    grammar = q(r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?")
    host = q(r'^(\[[0-9a-f:.]+\]|[^\x00-\x20"%/:<>?@\\\[\]^`{|}]+)$')
    t = f"regexp_replace({strip(url)}, '[\\t\\n\\r]', '', 'g')"
    fold = (
        f"list_reduce(list_transform({p}_seg[2:], lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '..' THEN "
        f"acc[1:greatest(len(acc) - 1, 0)] WHEN s[1] = '.' THEN acc ELSE list_concat(acc, s) END, CAST([] AS VARCHAR[]))"
    )
    dotted = (
        f"CASE WHEN regexp_matches({p}_p0, '/\\.') THEN regexp_replace('/' || coalesce(list_aggregate({fold}, 'string_agg', '/'), '') || "
        f"CASE WHEN {p}_seg[-1] IN ('.', '..') THEN '/' ELSE '' END, '^//$', '/') ELSE {p}_p0 END"
    )
    path_enc = _encode(f"{p}_p1", r'[^\x21-\x7e]|["<>`{}^]')
    query_enc = _encode(f"{p}_q0", r"""[^\x21-\x7e]|["<>#']""")
    return f"""(SELECT *, CASE WHEN {p}_ok THEN {p}_s0 END AS {p}_scheme, CASE WHEN {p}_ok THEN {p}_h0 END AS {p}_host,
  CASE WHEN {p}_ok THEN CASE WHEN ({p}_s0 = 'http' AND {p}_po = '80') OR ({p}_s0 = 'https' AND {p}_po = '443') THEN '' ELSE {p}_po END END AS {p}_port,
  CASE WHEN {p}_ok THEN regexp_extract({p}_a, '^(.*)@', 1) END AS {p}_user,
  CASE WHEN {p}_ok THEN coalesce({path_enc}, '') END AS {p}_path, CASE WHEN {p}_ok THEN coalesce({query_enc}, '') END AS {p}_query,
  {p}_scheme || '://' || CASE WHEN {p}_user <> '' THEN {p}_user || '@' ELSE '' END || {p}_host || CASE WHEN {p}_port <> '' THEN ':' || {p}_port ELSE '' END AS {p}_origin,
  {p}_origin || {p}_path || {p}_query AS {p}_href
 FROM (SELECT *, {t} AS {p}_t, regexp_extract({p}_t, {grammar}, 2) AS {p}_a, lower(regexp_extract({p}_t, {grammar}, 1)) AS {p}_s0,
  lower(regexp_replace(regexp_replace({p}_a, '^.*@', ''), ':[0-9]*$', '')) AS {p}_h0, regexp_extract({p}_a, ':([0-9]*)$', 1) AS {p}_po,
  coalesce(nullif(regexp_extract({p}_t, {grammar}, 3), ''), '/') AS {p}_p0, regexp_extract({p}_t, {grammar}, 4) AS {p}_q0,
  string_split({p}_p0, '/') AS {p}_seg, {dotted} AS {p}_p1,
  coalesce({p}_s0 IN ('http', 'https') AND regexp_matches({p}_h0, {host}), FALSE) AS {p}_ok
 FROM {src}))"""


def resolved(src: str, raw: str, base: str, out: str) -> str:
    """Sub-select adding ``out``: ``raw`` resolved against ``base``."""
    scheme = q(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")
    inner = f"""(SELECT *, {strip(raw)} AS {out}_r,
  CASE WHEN {out}_r = '' OR {out}_r LIKE '#%' OR lower(regexp_extract({out}_r, {scheme}, 1)) NOT IN ('', 'http', 'https') THEN NULL
   WHEN regexp_matches({out}_r, '(?i)^https?://') THEN {out}_r
   WHEN {out}_r LIKE '//%' THEN {out}_b_scheme || ':' || {out}_r
   WHEN {out}_r LIKE '/%' THEN {out}_b_origin || {out}_r
   WHEN {out}_r LIKE '?%' THEN {out}_b_origin || {out}_b_path || {out}_r
   ELSE {out}_b_origin || regexp_replace({out}_b_path, '[^/]*$', '') || {out}_r END AS {out}_abs
 FROM {parts(src, base, out + '_b')})"""
    return f"(SELECT *, {out}_u_href AS {out} FROM {parts(inner, out + '_abs', out + '_u')})"


def pairs(query: str) -> str:
    raw = f"list_filter(string_split(regexp_replace({query}, '^\\?', ''), '&'), lambda s: s <> '')"
    value = "CASE WHEN contains(s, '=') THEN substr(s, strpos(s, '=') + 1) ELSE '' END"
    return (
        f"list_transform({raw}, lambda s, i: {{'k': url_decode(replace(split_part(s, '=', 1), '+', ' ')), "
        f"'i': i, 'v': url_decode(replace({value}, '+', ' '))}})"
    )


def canonical(src: str, url: str, out: str, page: bool = False) -> str:
    """Sub-select adding the identity form of ``url`` as ``out``."""
    p = out + "_c"
    drop = names(K.TRACKING_KEYS + K.CACHE_BUSTER_KEYS)
    kept = f"list_sort(list_filter({pairs(p + '_query')}, lambda e: lower(e.k) NOT IN {drop} AND lower(e.k) NOT LIKE 'utm\\_%' ESCAPE '\\'))"
    text = f"list_aggregate(list_transform({kept}, lambda e: {form_encode('e.k')} || '=' || {form_encode('e.v')}), 'string_agg', '&')"
    path = f"regexp_replace({p}_path, '/{{2,}}', '/', 'g')"
    if page:
        path = f"coalesce(nullif(regexp_replace(regexp_replace({path}, {q(K.INDEX_FILE_REGEX)}, '/'), '/+$', ''), ''), '/')"
    return f"""(SELECT *, coalesce({p}_scheme || '://' || CASE WHEN {p}_user <> '' THEN {p}_user || '@' ELSE '' END || regexp_replace({p}_host, '\\.$', '')
   || CASE WHEN {p}_port <> '' THEN ':' || {p}_port ELSE '' END || {path} || coalesce('?' || nullif({text}, ''), ''), {url}) AS {out}
 FROM {parts(src, url, p)})"""


def filename(p: str, url: str) -> str:
    last = f"list_filter(string_split({p}_path, '/'), lambda s: s <> '')[-1]"
    return (
        f"CASE WHEN {p}_host IS NULL THEN coalesce(nullif(string_split({url}, '/')[-1], ''), {url}) "
        f"WHEN {last} IS NULL THEN {p}_host ELSE {decode(last)} END"
    )


def suffix(name: str, low: int, high: int) -> str:
    return f"nullif(lower(regexp_extract({name}, '(?i)\\.([a-z0-9]{{{low},{high}}})$', 1)), '')"


def image_extension(name: str) -> str:
    return f"CASE WHEN {suffix(name, 2, 5)} IN {names(K.IMAGE_EXTENSIONS)} THEN {suffix(name, 2, 5)} END"


def geo_format(name: str) -> str:
    ext = suffix(name, 2, 8)
    return (
        f"CASE WHEN {ext} IN {names(K.GEO_EXTENSIONS)} THEN {ext} "
        f"WHEN {ext} = 'zip' AND regexp_matches({name}, {q(K.SHAPEFILE_ZIP_REGEX)}) THEN 'shapefile-zip' END"
    )


def page_like(path: str) -> str:
    return f"coalesce(lower(regexp_extract({path}, '(?i)\\.([a-z0-9]{{1,8}})$', 1)) NOT IN {names(K.NON_PAGE_EXTENSIONS)}, FALSE)"


def domain(host: str) -> str:
    label = f"string_split(lower({host}), '.')"
    return (
        f"array_to_string(CASE WHEN len({label}) <= 2 THEN {label} WHEN length({label}[-1]) = 2 AND {label}[-2] IN {names(K.SECOND_LEVEL_LABELS)} "
        f"THEN {label}[-3:] ELSE {label}[-2:] END, '.')"
    )


def readable(path: str) -> str:
    one = f"{strip('regexp_replace(regexp_replace(' + decode('s') + ', ' + q(K.PAGE_SUFFIX_REGEX) + ', ' + q('') + '), ' + q('[-_+]+') + ', ' + q(' ') + ', ' + q('g') + ')')}"
    return f"list_transform(list_filter(string_split({path}, '/'), lambda s: s <> ''), lambda s: {one})"


def variant(p: str, url: str, out: str, src: str) -> str:
    suffix_re = q(K.RESPONSIVE_SUFFIX_REGEX)
    bare = f"{out}_stem"
    for _ in range(3):
        bare = f"regexp_replace({bare}, {suffix_re}, '')"
    return f"""(SELECT *, CASE WHEN {out}_bare <> {out}_stem OR len(list_filter({pairs(p + '_query')}, lambda e: lower(e.k) IN {names(K.RESIZE_KEYS)})) > 0
   THEN {p}_host || CASE WHEN {p}_port <> '' THEN ':' || {p}_port ELSE '' END || regexp_replace({p}_path, '[^/]*$', '') || {out}_bare
    || CASE WHEN regexp_matches({out}_name, '(?i)^.+\\.svg$') THEN '#svg' ELSE '#raster' END END AS {out}
 FROM (SELECT *, {filename(p, url)} AS {out}_name, CASE WHEN regexp_matches({out}_name, '^.+\\.[^.]*$') THEN regexp_replace({out}_name, '\\.[^.]*$', '') ELSE {out}_name END AS {out}_stem,
   {bare} AS {out}_bare FROM {parts(src, url, p)}))"""


NON_MARKUP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TAG = r"""<([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*)>"""


def attr(tag: str, name: str) -> str:
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
    return "(" + " || ".join(f"regexp_extract({tag}, {q(pattern)}, {g})" for g in (1, 2, 3)) + ")"


def page_hrefs() -> str:
    """Anchor tags of ``pages`` with 0-based position among all tags of the page."""
    return f"""(SELECT page_id, url, i - 1 AS ordinal, {entities(attr('t', 'href'))} AS href, lower({attr('t', 'rel')}) AS rel
 FROM (SELECT page_id, url, unnest(tags) AS t, generate_subscripts(tags, 1) AS i
  FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, {q(NON_MARKUP)}, '', 'g'), {q(TAG)}) AS tags FROM pages))
 WHERE regexp_matches(t, '(?i)^<a\\s') AND regexp_matches(t, '(?i)\\shref\\s*='))"""


def page_links() -> str:
    """Followable page-like links, distinct per page, first 500."""
    links = parts(resolved(page_hrefs(), "href", "url", "link"), "link", "k")
    return f"""(SELECT * FROM (SELECT page_id, url, link, min(ordinal) AS ordinal,
  row_number() OVER (PARTITION BY page_id ORDER BY min(ordinal)) AS rank FROM {links}
  WHERE link IS NOT NULL AND NOT contains(rel, 'nofollow') AND {page_like('k_path')} GROUP BY page_id, url, link))"""


__all__ = [n for n in dir() if not n.startswith("_")] + ["with_views"]
