"""URL expressions: parsing and resolution as the WHATWG rules define them for web links."""

from __future__ import annotations

from crawlsift.functions.sql import case, each, extract, extract_all, in_list, let, lit, matches, struct, substitute

# Schemes with an authority and hierarchical path, and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SPECIAL = "|".join(DEFAULT_PORTS)
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST = r"(?:\[[0-9A-Fa-f:.]+\]|[^\s/\\?#@:<>^|%\[\]]+)"
_OUTSIDE = r"\x00-\x20\x7f-\x{10ffff}"
_PATH_UNSAFE = _OUTSIDE + '"<>`{}^'
_QUERY_UNSAFE = _OUTSIDE + "\"<>'"
_FRAGMENT_UNSAFE = _OUTSIDE + '"<>`'
# an address that is already in canonical form, the usual case
_CANONICAL = (
    r"^(?:https?|ftp|wss?)://[a-z0-9._\-]+(?:/(?!\.)(?:[A-Za-z0-9._~!$&'()*+,;=:@|\-]|%(?!2[eE])|/(?!\.))*+)"
    r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?%|{}^`\[\]\-]*+)?(?:#[A-Za-z0-9._~!$&'()*+,;=:@/?%|{}^\[\]\-]*+)?\z"
)


def _strip(url: str) -> str:
    """Leading and trailing control characters and spaces go, as do tabs and newlines anywhere."""
    stripped = lambda u: substitute(u, r"^[\x00-\x20]++|[\t\n\r]++|[\x00-\x20](?<![\x00-\x20]{2})[\x00-\x20]*+\z")
    return let(url, lambda u: case((matches(u, r"[\x00-\x20]"), stripped(u)), otherwise=u))


def _encode(text: str, unsafe: str) -> str:
    """Percent-encode the characters of a class, as UTF-8 bytes."""
    escaped = lambda p: substitute(f"hex(encode({p}, 'UTF-8'))", "(..)", "%$1")
    pieces = lambda t: extract_all(t, f"(?s)[^{unsafe}]++|[{unsafe}]++")
    encoded = lambda t: "array_join(" + each(pieces(t), lambda p: case(
        (matches(p, f"(?s)^[{unsafe}]"), escaped(p)), otherwise=p)) + ", '')"
    return let(text, lambda t: case((matches(t, f"[{unsafe}]"), encoded(t)), otherwise=t))


def _dot_segments(path: str) -> str:
    """Resolve `.` and `..` (also written %2e) in an absolute path."""
    one, two = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    fold = (
        f"aggregate(split(substr({path}, 2), '/'), CAST(array() AS ARRAY<STRING>), (done, part) -> "
        + case((matches("part", two), "slice(done, 1, greatest(size(done) - 1, 0))"),
               (matches("part", one), "done"), otherwise="array_append(done, part)") + ")")
    tail = case((matches(path, r"(?i)/(?:\.|%2e){1,2}\z"), "'/'"), otherwise="''")
    joined = let(fold, lambda f: f"concat('/', array_join({f}, '/'), if(size({f}) > 0, {tail}, ''))")
    return case((matches(path, r"(?i)/(?:\.|%2e)"), joined), otherwise=path)


def _authority(scheme: str, authority: str) -> str:
    """Lower-cased host with the default port dropped; NULL when it is not a valid host."""
    valid = matches(authority, rf"^(?:[^@]*@)?{_HOST}(?::[0-9]{{0,5}})?$")
    host = f"lower({substitute(authority, '^.*@')})"
    port = f"concat({scheme}, ' ', {extract(host, ':([0-9]*)$', 1)})"
    defaults = [f"{s} {p}" for s, p in DEFAULT_PORTS.items()] + [f"{s} " for s in DEFAULT_PORTS]
    named = case((in_list(port, defaults), substitute(host, ":[0-9]*$")), otherwise=host)
    return case((valid, f"concat({extract(authority, '^(.*@)?', 0)}, {named})"))


def _canonicalise(url: str) -> str:
    """An absolute URL text in canonical form; NULL when its host is not valid."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
    opaque = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(.*)\z"
    slashes = f"replace({extract(url, pattern, 3)}, {lit(chr(92))}, '/')"
    pieces = struct(
        scheme=f"lower({extract(url, opaque, 1)})", host=extract(url, pattern, 2), path=slashes,
        query=extract(url, pattern, 4), fragment=extract(url, pattern, 5))

    def build(p: str) -> str:
        path = case((f"{p}.path = ''", "'/'"), otherwise=let(_encode(f"{p}.path", _PATH_UNSAFE), _dot_segments))
        return (
            f"concat({p}.scheme, '://', {_authority(f'{p}.scheme', f'{p}.host')}, {path}, "
            f"{_encode(f'{p}.query', _QUERY_UNSAFE)}, {_encode(f'{p}.fragment', _FRAGMENT_UNSAFE)})")

    rest = _encode(extract(url, opaque, 2), r"\x00-\x1f\x7f-\x{10ffff}")
    other = f"concat(lower({extract(url, opaque, 1)}), ':', {rest})"
    return case((matches(url, _CANONICAL), url), (matches(url, f"(?i)^(?:{_SPECIAL}):"), let(pieces, build)), otherwise=other)


def normalise_url(url: str) -> str:
    """An absolute URL in canonical form; NULL when it does not parse on its own."""
    return let(_strip(url), lambda u: case((matches(u, _ABSOLUTE), _canonicalise(u))))


def parse_base(url: str) -> str:
    """The pieces of a canonical page address that relative links need; NULL if it is not a web address."""
    part = lambda g: extract(url, rf"(?s)^({_SPECIAL})(://[^/?#]*)([^?#]*/)([^?#/]*)(\?[^#]*)?", g)
    return case((f"{part(1)} <> ''", struct(
        scheme=part(1), origin=f"concat({part(1)}, {part(2)})", folder=part(3), file=part(4), query=part(5))))


def resolve_url(base: str, href: str, on_fail: str = "null") -> str:
    """Join `href` to a parsed base. On failure: NULL, the raw text ('raw') or '' ('empty')."""
    page = f"{base}.origin, {base}.folder, {base}.file"

    def join(h: str) -> str:
        return case(
            (matches(h, _ABSOLUTE), h),
            (matches(h, r"^[/\\]{2}"), f"concat({base}.scheme, ':', {h})"),
            (matches(h, r"^[/\\]"), f"concat({base}.origin, {h})"),
            (f"startswith({h}, '?')", f"concat({page}, {h})"),
            (f"{h} = '' OR startswith({h}, '#')", f"concat({page}, {base}.query, {h})"),
            otherwise=f"concat({base}.origin, {base}.folder, {h})")

    joined = let(let(_strip(href), join), _canonicalise)
    return joined if on_fail == "null" else f"coalesce({joined}, {href if on_fail == 'raw' else lit('')}, '')"


def absolute_or(base: str, href: str, on_fail: str) -> str:
    """As `resolve_url`, but a missing or empty href gives NULL (or '') without touching the base."""
    otherwise = "CAST(NULL AS STRING)" if on_fail == "null" else "''"
    return let(href, lambda h: case((f"{h} <> ''", resolve_url(base, h, on_fail)), otherwise=otherwise))


def host_of(url: str) -> str:
    """Lower-cased host name without port, or ''."""
    pattern = (rf"(?s)^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{{2,}}(?:[^/\\?#@]*@)?({_HOST})"
               r"(?::[0-9]{0,5})?(?:[/\\?#].*)?\z")
    return f"coalesce(lower({extract(url, pattern, 1)}), '')"


def protocol_of(url: str) -> str:
    """Scheme with its colon (`https:`), or NULL."""
    return f"nullif(lower({extract(url, r'^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.\-]*:)', 1)}), '')"


def origin_of(url: str) -> str:
    """scheme://host[:non-default port] of a canonical web URL (see `normalise_url`), else NULL."""
    return f"nullif({substitute(extract(url, rf'^(?:{_SPECIAL})://[^/?#]+'), '//[^@]*@', '//')}, '')"


def web_origin(url: str) -> str:
    """origin_of the normalised url. A plain lower-case host says it without normalising the rest."""
    plain = lambda u: extract(u, r"^https?://[a-z0-9._\-]+(?=/|\z)")
    return let(url, lambda u: let(plain(u), lambda o: case((f"{o} <> ''", o), otherwise=origin_of(normalise_url(u)))))


def is_absolute_http_url(url: str) -> str:
    pattern = rf"(?is)^[\x00-\x20]*https?:[/\\]*(?:[^/\\?#@]*@)?{_HOST}(?::[0-9]{{0,5}})?(?:[/\\?#].*)?\z"
    return f"coalesce({matches(url, pattern)}, false)"


def file_name_of(src: str) -> str:
    """Last path segment without query, fragment or a 1-5 character extension."""
    path = substitute(substitute(src, r"(?s)[?#].*\z"), rf"{_ABSOLUTE}(?://[^/]*)?")
    bare = substitute(extract(path, r"([^/]+)/*\z", 1), r"(?i)\.[a-z0-9]{1,5}\z")
    return case((f"{src} IS NULL OR {matches(src, r'(?i)^\s*(?:data|blob):')}", "''"), otherwise=bare)


def host_suffixes(host: str) -> str:
    """`a.b.c` -> [a.b.c, b.c, c]: turns "domain or subdomain of" into an equi-join."""
    suffixes = let(f"split({host}, '[.]')", lambda p: each(
        f"sequence(1, size({p}))", lambda i: f"array_join(slice({p}, {i}, size({p})), '.')"))
    return case((f"{host} <> ''", suffixes), otherwise="CAST(array() AS ARRAY<STRING>)")


def name_prefixes(name: str) -> str:
    """`abc` -> [a, ab, abc]: turns "starts with" into an equi-join."""
    return case((f"length({name}) > 0", each(f"sequence(1, length({name}))", lambda i: f"substr({name}, 1, {i})")),
                otherwise="CAST(array() AS ARRAY<STRING>)")


def host_matches(host: str, domain: str) -> str:
    """Host is the domain itself or a subdomain of it, never a lookalike."""
    return f"({host} = {lit(domain)} OR endswith({host}, {lit('.' + domain)}))"
